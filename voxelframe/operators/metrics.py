"""Losses and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.pooling import crps_mean, heaviside, normal_cdf
from voxelframe.functions.scalars import clip
from voxelframe.operators.ranking import top_n


def _log_likelihood(p: Column, t: Column, eps: float) -> Column:
    q = clip(p, eps, 1 - eps)
    return t * F.log(q) + (1 - t) * F.log(1 - q)


def log_loss(p: str | Column, label: str | Column, eps: float = 1e-15) -> Column:
    """Aggregate: mean negative log likelihood."""
    p, y = _col(p), _col(label).cast("double")
    return -F.avg(_log_likelihood(p, y, eps))


def cross_entropy(p: str | Column, target: str | Column, eps: float = 1e-12, signed: bool = False) -> Column:
    """Aggregate: mean log likelihood; the sign is only turned with ``signed``."""
    mean = F.avg(_log_likelihood(_col(p), _col(target).cast("double"), eps))
    return -mean if signed else mean


def binary_cross_entropy(p: Column, target: Column, eps: float = 1e-12) -> Column:
    """Row loss; the target is clipped to [0, 1]."""
    return -_log_likelihood(p, clip(target.cast("double"), 0.0, 1.0), eps)


def categorical_cross_entropy(probabilities: Column, target: Column, eps: float = 1e-12) -> Column:
    """Row loss: -ln of the probability of the 0-based target class."""
    return -F.log(clip(F.element_at(probabilities, target.cast("int") + 1), eps, 1 - eps))


def squared_error(p: Column, target: Column) -> Column:
    return (p - target) * (p - target)


def bounded_cross_entropy(p: Column, target: Column, eps: float = 1e-12) -> Column:
    """Row value CE(t, p) - CE(t, t), with the target kept off 0 and 1."""
    t = clip(target, eps, 1 - eps)
    return _log_likelihood(p, t, eps) - (t * F.log(t) + (1 - t) * F.log(1 - t))


def dice(p: Column, t: Column, eps: float = 1e-12) -> Column:
    """Aggregate over voxels."""
    return (2 * F.sum(p * t) + F.lit(eps)) / (F.sum(p) + F.sum(t) + F.lit(eps))


def covered(p: Column, t: Column, share: float = 0.1) -> Column:
    """Aggregate: does the prediction cover more than the share of the target?"""
    return F.coalesce(F.try_divide(F.sum(p * t), F.sum(t)) > F.lit(share), F.lit(False))


def confusion(df: DataFrame, p: str, label: str, threshold: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    hit, pos = F.col(p) >= threshold, F.col(label) == 1
    neg = F.col(label) == 0
    return df.groupBy(*by).agg(
        F.count_if(pos & hit).alias("tp"), F.count_if(neg & ~hit).alias("tn"),
        F.count_if(neg & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"),
        F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"),
    )


def detection_per_patient(
    flagged: DataFrame, annotations: DataFrame, by: str = "pid", patients: DataFrame | None = None
) -> DataFrame:
    """Blobs, true detections and annotations per patient.

    ``patients`` lists whom to count; by default everyone with a blob or an annotation. A patient
    without blobs misses all its annotations.
    """
    b = flagged.groupBy(by).agg(F.count(F.lit(1)).alias("n_blobs"), F.sum("flag").cast("long").alias("tp"))
    a = annotations.groupBy(by).agg(F.count(F.lit(1)).alias("n_pos"))
    if patients is None:
        both = b.join(a, by, "full_outer")
    else:
        both = patients.select(by).distinct().join(b, by, "left").join(a, by, "left")
    return both.fillna(0, ["n_blobs", "tp", "n_pos"]).withColumn("missed", F.col("tp") < F.col("n_pos"))


def detection_totals(per_patient: DataFrame) -> DataFrame:
    return per_patient.agg(
        F.count(F.lit(1)).alias("n_patients"), F.sum("tp").cast("long").alias("tp"),
        F.sum("n_blobs").cast("long").alias("n_blobs"), F.sum("n_pos").cast("long").alias("n_pos"),
        F.count_if("missed").alias("n_missed"),
    )


def detection_in_top(
    flagged: DataFrame, annotations: DataFrame, n: int, score: str = "p", by: str = "pid", cid: str = "cid",
    patients: DataFrame | None = None,
) -> DataFrame:
    """True and false positives among the n slots of each patient, and the totals, one row."""
    first = top_n(flagged, n, score, by, cid).groupBy(by).agg(F.sum("flag").cast("long").alias("tp_top"))
    everything = detection_per_patient(flagged, annotations, by, patients)
    joined = everything.join(first, by, "left").fillna(0, ["tp_top"])
    return joined.agg(
        F.sum("tp").cast("long").alias("tp"), F.sum("n_pos").cast("long").alias("n_pos"),
        F.sum("tp_top").cast("long").alias("tp_top"), F.sum(F.lit(n) - F.col("tp_top")).cast("long").alias("fp_top"),
    )


def mask_recall(located: DataFrame, by: str = "pid") -> DataFrame:
    """Per patient: annotations, how many lie inside the mask, and whether one is missed."""
    return located.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n_inside")
    ).withColumn("missed", F.col("n_inside") < F.col("n"))


def crps(mu: Column, sigma: Column, target: Column, n: int, exact: bool = False) -> Column:
    """Row value: mean over 0..n-1 of (normal CDF - step at the target)^2."""
    if not exact:
        return crps_mean(mu, sigma, target, n)
    cdf, step = normal_cdf(mu, sigma, n, exact), heaviside(target, n)
    squares = F.zip_with(cdf, step, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda s, v: s + v) / F.lit(float(n))


def prior_log_odds(labels: DataFrame, label: str = "label") -> DataFrame:
    """Class log priors used as a bias: negatives over n + 1, positives over n, as in the fixed
    form ln((n - pos) / (n + 1)), ln(pos / n)."""
    agg = labels.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label)).cast("double").alias("pos")
    )
    return agg.select(
        F.log((F.col("n") - F.col("pos")) / (F.col("n") + 1)).alias("b0"),
        F.log(F.col("pos") / F.col("n")).alias("b1"),
    )


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
