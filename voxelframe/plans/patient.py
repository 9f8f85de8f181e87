"""From scored candidates to patient predictions and their log loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.pooling import log_mean_exp
from voxelframe.operators.joins import require_same_keys
from voxelframe.operators.metrics import log_loss
from voxelframe.operators.ranking import top_n_padded


def patient_predictions(
    candidates: DataFrame, patients: DataFrame, n: int = 8, threshold: float = 0.75, r: float = 16.0,
    score: str = "p", by: str = "pid", cid: str = "cid",
) -> DataFrame:
    """Log-mean-exp over exactly n slots of every listed patient.

    The slots hold the patient's first n candidates; scores below the threshold and slots without
    a candidate count as 0. Candidates of others are left out before the ranking.
    """
    listed = patients.select(by).distinct()
    best = top_n_padded(candidates.select(by, cid, score).join(listed, by, "left_semi"), listed, n, score, by, cid)
    slot = F.when(F.col(score) >= threshold, F.col(score)).otherwise(F.lit(0.0))
    return best.groupBy(by).agg(log_mean_exp(slot, r).alias("prediction"))


def patient_log_loss(predictions: DataFrame, labels: DataFrame, by: str = "pid") -> DataFrame:
    """Number of labelled patients and their log loss; predictions and labels must be of the same patients."""
    return require_same_keys(predictions, labels.select(by, "label"), by).agg(
        F.count(F.lit(1)).alias("n"), log_loss("prediction", "label").alias("log_loss")
    )
