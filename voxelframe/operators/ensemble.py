"""Model selection and averaging over the predictions of several configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.joins import keep_known, require_same_keys
from voxelframe.operators.metrics import log_loss
from voxelframe.operators.sampling import k_folds


def average(predictions: DataFrame, configs: list[str] | DataFrame | None = None, key: str = "pid", config: str = "config") -> DataFrame:
    """Equal-weight mean per patient over all, listed or selected configurations."""
    if isinstance(configs, list):
        predictions = predictions.filter(F.col(config).isin(configs))
    elif configs is not None:
        predictions = keep_known(predictions, configs, config)
    return predictions.groupBy(key).agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n_configs"))


def scores(predictions: DataFrame, labels: DataFrame, key: str = "pid", config: str = "config") -> DataFrame:
    """Log loss of every configuration; each must predict every labelled patient once."""
    return require_same_keys(predictions, labels, key, [config]).groupBy(config).agg(log_loss("p", "label").alias("loss"))


def best_config(predictions: DataFrame, labels: DataFrame, key: str = "pid", config: str = "config") -> DataFrame:
    s = scores(predictions, labels, key, config)
    return s.agg(F.min_by(F.col(config), F.struct("loss", config)).alias(config), F.min("loss").alias("loss"))


def best_per_fold(
    predictions: DataFrame, labels: DataFrame, k: int, seed: str, key: str = "pid", config: str = "config"
) -> DataFrame:
    """Best configuration on each training part of a stratified k-fold split (all folds but one).

    Each configuration must predict every labelled patient once.
    """
    folds = k_folds(labels, k, seed, key)
    left_out = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold")))
    parts = folds.withColumn("left_out", left_out).select(key, "label", "left_out")
    complete = require_same_keys(predictions, labels.select(key), key, [config])
    s = complete.join(parts, key).groupBy("left_out", config).agg(log_loss("p", "label").alias("loss"))
    return s.groupBy("left_out").agg(
        F.min_by(F.col(config), F.struct("loss", config)).alias(config), F.min("loss").alias("loss")
    )


def rename_models(df: DataFrame, config: str = "config", old: str = "_spl$", new: str = "_all") -> DataFrame:
    """Names of the models trained on all data from those trained on a split."""
    return df.withColumn(config, F.regexp_replace(config, old, new))
