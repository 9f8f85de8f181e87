"""Python kernels over bounded pieces (slabs, bricks, slices), many pieces per call."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def piece_index(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """0-based number of the piece of each row of a frame sorted by the keys."""
    new = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        values = pdf[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def split_pieces(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    index = piece_index(pdf, keys)
    starts = np.flatnonzero(np.diff(index, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(pdf))):
        yield pdf.iloc[a:b]


def map_pieces(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType
) -> DataFrame:
    """Apply ``fn`` to frames made of one or more whole pieces, sorted by keys and order.

    Rows are hashed by piece and streamed in sorted batches; only the piece at the end of a batch is held
    back, so a task's memory is bounded by the largest piece, and small pieces share one call. The number
    of partitions is fixed to ``spark.sql.shuffle.partitions``: these stages are bound by computing, and
    merging partitions because they are small in bytes would leave cores idle.
    """
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def last_key(pdf: pd.DataFrame) -> tuple:
        return tuple(pdf[k].iloc[-1] for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            index = piece_index(pdf, keys)
            start = int(np.searchsorted(index, index[-1]))
            if start == 0 and held and last_key(held[-1]) == last_key(pdf):
                held.append(pdf)
                continue
            done = held + ([pdf.iloc[:start]] if start else [])
            if done:
                yield fn(pd.concat(done, ignore_index=True))
            held = [pdf.iloc[start:]]
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
