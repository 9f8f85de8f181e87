"""Ranking and top-n of scored candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.scalars import HeadLayout, logodds_to_p
from voxelframe.plans.ordered import rank_within, value_bucket

# Coefficients of the clinical log-odds blend.
SIZE_SLOPE = 5.3854
SIZE_OFFSET = 1.58113883
TEXTURE_PART_SOLID = -0.1276
TEXTURE_NON_SOLID = 0.377
SPICULATION = 0.7729

Strategy = Callable[[HeadLayout, str], Column]


def by_malignancy(layout: HeadLayout, features: str = "features") -> Column:
    return layout.get(features, "malignancy") / 5


def by_nodule_malignancy(layout: HeadLayout, features: str = "features") -> Column:
    return layout.unit(features, "nodule", 1) * layout.get(features, "malignancy") / 5


def by_clinical_blend(layout: HeadLayout, features: str = "features") -> Column:
    """Nodule probability times (malignancy + probability from size, texture and spiculation)."""
    size_term = F.lit(SIZE_SLOPE) * (
        F.pow(layout.get(features, "size") / 10, F.lit(-0.5)) - F.lit(SIZE_OFFSET)
    )
    texture_term = (
        layout.unit(features, "texture", 1) * F.lit(TEXTURE_PART_SOLID)
        + layout.unit(features, "texture", 2) * F.lit(TEXTURE_NON_SOLID)
    )
    spic_term = F.lit(SPICULATION) * (layout.get(features, "spiculation") / 5)
    risk = logodds_to_p(size_term + texture_term + spic_term)
    return layout.unit(features, "nodule", 1) * (layout.get(features, "malignancy") / 5 + risk)


def by_nodule(layout: HeadLayout, features: str = "features") -> Column:
    return layout.unit(features, "nodule", 1)


def by_bounded_malignancy(layout: HeadLayout, features: str = "features") -> Column:
    return layout.get(features, "malignancy")


def rank_candidates(
    df: DataFrame, score: str = "p", by: str = "pid", cid: str = "cid", out: str = "rank",
    step: float | None = None,
) -> DataFrame:
    """Rank by score descending, ties by id.

    The order is cut by splitters of (score, id), so equal scores are cut as well; ``step`` cuts it by score ranges instead, where
    scores are known to spread.
    """
    bucket = None if step is None else value_bucket(-F.col(score), step)
    return rank_within(df, [by], [F.desc(score), F.asc(cid)], bucket, out)


def top_n(
    df: DataFrame, n: int, score: str = "p", by: str = "pid", cid: str = "cid", out: str = "rank"
) -> DataFrame:
    """First n per group; the limit is applied before the shuffle as well as after it."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(cid))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def top_n_padded(
    df: DataFrame, patients: DataFrame, n: int, score: str = "p", by: str = "pid", cid: str = "cid",
    out: str = "rank",
) -> DataFrame:
    """Exactly n slots per patient; slots without a candidate have NULL columns."""
    slots = patients.select(by).distinct().withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(n))))
    return slots.join(top_n(df, n, score, by, cid, out), [by, out], "left")


def top_score_report(df: DataFrame, n: int, score: str = "p", by: str = "pid", cid: str = "cid") -> DataFrame:
    """Scores of the first n as one array of at most n numbers."""
    best = top_n(df, n, score, by, cid)
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.col(score).alias("s"))))
    return best.groupBy(by).agg(F.transform(pairs, lambda p: p["s"]).alias("scores"))


def extremes(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n smallest and n largest rows of a table, each side a distributed top-n."""
    low = df.orderBy(F.asc(value), F.asc(key)).limit(n).withColumn("side", F.lit("low"))
    high = df.orderBy(F.desc(value), F.asc(key)).limit(n).withColumn("side", F.lit("high"))
    return low.unionByName(high)


def best_epoch(df: DataFrame, by: Sequence[str], error: str, index: str) -> DataFrame:
    """Lowest error and the first index at which it occurs."""
    return df.groupBy(*by).agg(
        F.min(error).alias("best"), F.min_by(F.col(index), F.struct(error, index)).alias("best_at")
    )
