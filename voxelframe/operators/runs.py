"""Training-log lines as learning curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.ranking import best_epoch
from voxelframe.plans.ordered import forward_fill, previous_value, running_sum, value_bucket

# The line formats of the training log.
CHUNK_LINE = r"Chunk (\d+)/"
TRAIN_LINE = r"Mean train loss:\s*([0-9.eE+-]+)"
VALID_LINE = r"Validation loss:\s*([0-9.eE+-]+)"


def _number(line: str, pattern: str, kind: str) -> Column:
    text = F.regexp_extract(line, pattern, 1)
    return F.when(text != "", text.cast(kind))


def with_chunk(
    logs: DataFrame, run: str = "run", line_no: str = "line_no", line: str = "line", width: float = 4096
) -> DataFrame:
    """Add the chunk last announced at or before each line of the run."""
    marked = logs.withColumn("__chunk", _number(line, CHUNK_LINE, "long"))
    filled = forward_fill(marked, [run], [line_no], "__chunk", value_bucket(F.col(line_no), width), "chunk")
    return filled.drop("__chunk")


def parse_losses(logs: DataFrame, line: str = "line") -> DataFrame:
    """Lines that report a loss, with ``kind`` (train or valid) and ``loss``."""
    train, valid = _number(line, TRAIN_LINE, "double"), _number(line, VALID_LINE, "double")
    kind = F.when(train.isNotNull(), "train").when(valid.isNotNull(), "valid")
    return (
        logs.withColumn("kind", kind).withColumn("loss", F.coalesce(train, valid))
        .filter(F.col("kind").isNotNull())
    )


def learning_curves(logs: DataFrame, run: str = "run", line_no: str = "line_no", width: float = 4096) -> DataFrame:
    """(run, line_no, chunk, kind, loss) for every loss line; chunk is -1 before the first chunk."""
    return (
        parse_losses(with_chunk(logs, run, line_no, width=width))
        .fillna(-1, ["chunk"]).select(run, line_no, "chunk", "kind", "loss")
    )


def best_of_curves(curves: DataFrame, run: str = "run", line_no: str = "line_no") -> DataFrame:
    """Lowest loss per run and kind, with the line and chunk at which it occurs first."""
    best = best_epoch(curves, [run, "kind"], "loss", line_no)
    at = curves.groupBy(run, "kind").agg(F.min_by(F.col("chunk"), F.struct("loss", line_no)).alias("best_chunk"))
    return best.join(at, [run, "kind"])


def boundary_groups(
    df: DataFrame, by: Sequence[str], order: Sequence[str], key: str, bucket: Column, out: str = "run_no"
) -> DataFrame:
    """Number the stretches of equal ``key`` along the order, from 1."""
    before = previous_value(df, by, order, key, bucket, "__prev")
    # the first row has no predecessor and opens group 1
    flagged = before.withColumn("__new", F.when(F.col("__prev").eqNullSafe(F.col(key)), 0).otherwise(1))
    return running_sum(flagged, by, order, "__new", bucket, out).drop("__prev", "__new")
