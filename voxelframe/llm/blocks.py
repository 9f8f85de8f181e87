"""A set of queries against all rows, in blocks of bounded size.

Rows are dealt into blocks; every query goes to every block, so the smaller side is what is copied. In a task a block's rows come first
and are built into something to search, then the queries stream past it. Neither side is ever whole in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def number_of_blocks(n: int, most: int, least: int, tasks: int = 64) -> int:
    """Blocks of at most about ``most`` rows; small tables give up to ``tasks`` blocks of at least ``least`` rows."""
    return max(1, -(-n // most), min(tasks, -(-n // least)))


def against_blocks(
    rows: DataFrame, queries: DataFrame, n: int, key: str, make: Callable[[pa.Table], object],
    answer: Callable[[object, pa.Table], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """``answer(make(block), queries)`` for each block of rows, of ``n`` blocks by a hash of the key, and all queries in batches."""
    def null(df: DataFrame):
        return F.lit(None).cast(df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType)

    left = rows.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"), F.lit(0).alias("kind"), F.struct(*rows.columns).alias("row"), null(queries).alias("query"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(1).alias("kind"), null(rows).alias("row"), F.struct(*queries.columns).alias("query"))

    def table(parts: list[pa.RecordBatch], column: int) -> pa.Table:
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(p.column(column)) for p in parts]).combine_chunks()

    def run(batches):
        block, held, state = None, [], None
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            for lo, hi in zip(starts, np.append(starts[1:], len(key))):
                part = b.slice(lo, hi - lo)
                if key[lo] // 2 != block:
                    block, held, state = key[lo] // 2, [], None
                if key[lo] % 2 == 0:
                    held.append(part)
                    continue
                if held:
                    state, held = make(table(held, 2)), []
                if state is not None:
                    yield from answer(state, table([part], 3))

    both = left.unionByName(right).repartition(n, "block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, schema)
