"""Incremental jobs: scoring of newly arrived patients and running learning curves.

Both drain what has arrived (``availableNow``) and can be started again at any time: progress lives in
the checkpoint folder, and each micro-batch writes to a folder of its own number, so a repeated batch
replaces its first attempt. All folders must be shared by the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe.operators.runs import learning_curves, parse_losses
from voxelframe.operators.scoring import Scorer, score_patches


def _stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def score_new_patients(
    spark: SparkSession, arriving: str, results: str, checkpoint: str, scorer: Scorer, schema: T.StructType,
    pid: str = "pid", patch: str = "v", files_per_batch: int = 1000, keys: Sequence[str] | None = None,
) -> DataFrame:
    """Score every row of the ``arriving`` folder whose key has no result yet; returns all results.

    ``keys`` identify a row: the patient by default, patient and candidate where a patient has several
    patches. A key that arrives again, in this run or a later one, keeps its first result; of equal keys
    in one batch the patch with the smallest hash counts, so a repeated batch scores the same rows.
    """
    keys = list(keys or [pid])
    out_schema = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys) + ", p double, batch long"

    def each(batch: DataFrame, number: int) -> None:
        done = _stored(spark, results, out_schema).filter(F.col("batch") != number).select(*keys)
        first = Window.partitionBy(*keys).orderBy(F.xxhash64(patch))
        once = batch.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
        scored = score_patches(once.join(done, keys, "left_anti"), scorer, patch, keep=tuple(keys))
        scored.write.mode("overwrite").parquet(f"{results.rstrip('/')}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arriving)
    _drain(stream, checkpoint, each)
    return _stored(spark, results, out_schema).drop("batch")


def follow_logs(
    spark: SparkSession, arriving: str, table: str, best: str, checkpoint: str, files_per_batch: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """Follow text logs of ``run<TAB>line number<TAB>line``; returns (curves, running best).

    One stream parses the files. Each batch appends its lines to ``table``, from which the curves are
    computed, so a line that arrives late still gets the right chunk; then it writes the best loss per run
    and kind so far, from the state before it and its own lines, to a folder of its own number. The last
    finished folder is the result: a batch that fails leaves the one before readable.
    """
    text = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(arriving)
    parts = F.split("value", "\t", 3)
    parsed = text.select(
        parts[0].cast("long").alias("run"), parts[1].cast("long").alias("line_no"), parts[2].alias("line")
    )
    best_schema = "run long, kind string, best double, best_at long, batch long"

    def state(before: int | None = None) -> DataFrame:
        every = _stored(spark, best, best_schema)
        if before is not None:
            every = every.filter(F.col("batch") < before)
        return every.join(every.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")
        lines = spark.read.schema("run long, line_no long, line string").parquet(f"{table.rstrip('/')}/batch={number}")
        losses = parse_losses(lines).select("run", "kind", "loss", "line_no")
        both = losses.unionByName(state(number).select("run", "kind", F.col("best").alias("loss"), F.col("best_at").alias("line_no")))
        low = both.groupBy("run", "kind").agg(F.min(F.struct("loss", "line_no")).alias("b"))
        found = low.select("run", "kind", F.col("b.loss").alias("best"), F.col("b.line_no").alias("best_at"))
        found.write.mode("overwrite").parquet(f"{best.rstrip('/')}/batch={number}")

    _drain(parsed, checkpoint, append)
    lines = _stored(spark, table, "run long, line_no long, line string, batch long").drop("batch")
    return learning_curves(lines), state()
