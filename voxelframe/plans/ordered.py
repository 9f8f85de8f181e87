"""Ordered computations on groups of any size.

A window over ``partitionBy(group)`` sorts a whole group in one task, which fails to scale when one
group holds a large share of the rows. The functions here cut every group into *buckets* that follow
the sort order, work inside (group, bucket), and carry a one-row-per-bucket summary across buckets.
A bucket is any column that never decreases along the sort order: a slice of a uniform hash, a
floor of the sort value, a time slot. Where no such column is known, :func:`range_buckets` cuts the table by splitters that
Spark samples from the order itself, so ties and groups with one value are cut like all else.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.session import cut as checkpointed
from voxelframe.session import uncut

BUCKET = "__bucket"


def bucket_count(df: DataFrame, per_bucket: int = 32 << 20, least: int = 256) -> int:
    """Buckets of about ``per_bucket`` bytes by the planner's size of the table, ``least`` or more.

    A table of unknown size (the planner then assumes exabytes) gets four per shuffle partition.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return max(least, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // per_bucket))


def range_buckets(df: DataFrame, by: Sequence[str], order: Sequence[Column], per_bucket: int = 500_000) -> DataFrame:
    """The table with ``BUCKET``: contiguous stretches of about ``per_bucket`` rows of the order (by, order), which should be total.

    The stretches are those of a range partitioning. Its input is read more than once and stands in a checkpoint until the result does, so all that reads it sees the same stretches.
    """
    stored = checkpointed(df)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // per_bucket))
    dealt = stored.repartitionByRange(n, *[F.asc(c) for c in by], *order)
    out = checkpointed(dealt.withColumn(BUCKET, F.spark_partition_id().cast("long")))
    uncut(stored)
    return out


def hash_bucket(u: Column, n: int = 256) -> Column:
    """Equal slices of a uniform in [0, 1)."""
    return F.floor(u * F.lit(n)).cast("long")


def value_bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, NULL equal to NULL, keeping one copy of the keys."""
    renamed = right.select([F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _across(by: Sequence[str]) -> Window:
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET)


def rank_within(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    bucket: Column | None = None,
    out: str = "rank",
) -> DataFrame:
    """1-based ``row_number`` of each row in its group; ``by`` may be empty for a total order. Without a bucket the order is cut by range."""
    by = list(by)
    cut = range_buckets(df, by, order) if bucket is None else df.withColumn(BUCKET, bucket)
    sizes = cut.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        *by,
        BUCKET,
        F.coalesce(
            F.sum("__n").over(_across(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
    )
    inside = cut.withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy(*order))
    )
    return (
        attach(inside, before, by + [BUCKET])
        .withColumn(out, (F.col("__rn") + F.col("__before")).cast("long"))
        .drop("__rn", "__before", BUCKET)
    )


def running_sum(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """Inclusive running total along the order."""
    by = list(by)
    cut = df.withColumn(BUCKET, bucket)
    totals = cut.groupBy(*by, BUCKET).agg(F.sum(value).alias("__s"))
    before = totals.select(
        *by,
        BUCKET,
        F.coalesce(
            F.sum("__s").over(_across(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
    )
    w = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn("__in", F.sum(value).over(w))
    return (
        attach(inside, before, by + [BUCKET])
        .withColumn(out, F.col("__in") + F.col("__before"))
        .drop("__in", "__before", BUCKET)
    )


def previous_value(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """``lag`` by one row; the first row of a bucket reads the last row of the bucket before."""
    by = list(by)
    cut = df.withColumn(BUCKET, bucket)
    tails = cut.groupBy(*by, BUCKET).agg(
        F.max_by(F.struct(value), F.struct(*order)).alias("__tail")
    )
    carried = tails.select(*by, BUCKET, F.lag("__tail").over(_across(by)).alias("__carry"))
    w = Window.partitionBy(*by, BUCKET).orderBy(*order)
    inside = cut.withColumn("__first", F.row_number().over(w) == 1).withColumn(
        "__in", F.lag(value).over(w)
    )
    return (
        attach(inside, carried, by + [BUCKET])
        .withColumn(out, F.when(F.col("__first"), F.col(f"__carry.{value}")).otherwise(F.col("__in")))
        .drop("__first", "__in", "__carry", BUCKET)
    )


def rank_and_previous(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, rank: str = "rank", previous: str = "previous"
) -> DataFrame:
    """1-based number of each row in its group and the value of the row before it, the order cut by range."""
    by = list(by)
    cut = range_buckets(df, by, [F.asc(c) for c in order])
    sizes = cut.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__tail"))
    carried = sizes.select(
        *by, BUCKET, F.coalesce(F.sum("__n").over(_across(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.lag("__tail").over(_across(by)).alias("__carry"),
    )
    w = Window.partitionBy(*by, BUCKET).orderBy(*order)
    inside = cut.withColumn("__rn", F.row_number().over(w)).withColumn("__in", F.lag(value).over(w))
    return (
        attach(inside, carried, by + [BUCKET])
        .withColumn(previous, F.when(F.col("__rn") == 1, F.col("__carry.v")).otherwise(F.col("__in")))
        .withColumn(rank, (F.col("__rn") + F.col("__before")).cast("long"))
        .drop("__rn", "__in", "__carry", "__before", BUCKET)
    )


def forward_fill(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """Last non-NULL value at or before each row."""
    by = list(by)
    cut = df.withColumn(BUCKET, bucket)
    seen = F.col(value).isNotNull()
    tails = cut.groupBy(*by, BUCKET).agg(
        F.max_by(F.col(value), F.when(seen, F.struct(*order))).alias("__tail")
    )
    carried = tails.select(
        *by,
        BUCKET,
        F.last("__tail", ignorenulls=True)
        .over(_across(by).rowsBetween(Window.unboundedPreceding, -1))
        .alias("__carry"),
    )
    w = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn("__in", F.last(value, ignorenulls=True).over(w))
    return (
        attach(inside, carried, by + [BUCKET])
        .withColumn(out, F.coalesce("__in", "__carry"))
        .drop("__in", "__carry", BUCKET)
    )
