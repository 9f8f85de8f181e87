"""Streams keep what was there when a batch fails; disk chains shuffle once."""

import pytest
from pyspark.sql import functions as F

from voxelframe.operators import morphology as M
from voxelframe.operators.scoring import LinearSigmoid
from voxelframe.session import scratch_path
from voxelframe.streaming import jobs


@pytest.mark.parametrize("chain", [
    lambda d: M.open_disk(d, "m", 2),
    lambda d: M.close_disk(d, "m", 3),
    lambda d: M.erode_disk(M.close_disk(M.erode_disk(M.by_slice(d), "m", 2, placed=True), "m", 1, placed=True), "m", 2, placed=True),
])
def test_disk_chain_has_one_exchange(spark, chain):
    dense = spark.range(2 * 3 * 5 * 5).select(
        (F.col("id") % 2).alias("pid"), (F.floor(F.col("id") / 2) % 3).alias("z"),
        (F.floor(F.col("id") / 6) % 5).alias("y"), F.floor(F.col("id") / 30).alias("x"), (F.col("id") % 4 == 0).cast("int").alias("m"),
    )
    plan = chain(dense)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_patient_with_several_patches(spark):
    base = scratch_path(spark, "stream")
    rows = spark.createDataFrame([(1, 1, [1.0]), (1, 2, [2.0]), (1, 1, [3.0]), (2, 1, [1.0])], "pid long, cid long, v array<float>")
    rows.write.parquet(f"{base}/in")
    model = LinearSigmoid([1.0], 0.0)

    def run():
        return jobs.score_new_patients(spark, f"{base}/in", f"{base}/out", f"{base}/state", model, rows.schema, keys=["pid", "cid"])

    first = sorted(run().collect())
    assert [(r.pid, r.cid) for r in first] == [(1, 1), (1, 2), (2, 1)]
    assert sorted(run().collect()) == first


def test_failed_batch_leaves_the_old_best(spark, monkeypatch):
    base = scratch_path(spark, "logs")

    def deliver(*lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{base}/in")

    def follow():
        curves, best = jobs.follow_logs(spark, f"{base}/in", f"{base}/table", f"{base}/best", f"{base}/state")
        return curves.count(), sorted((r.run, r.kind, r.best, r.best_at) for r in best.collect())

    deliver("1\t1\tChunk 1/9", "1\t2\tMean train loss: 0.5", "1\t3\tMean train loss: 0.7")
    assert follow() == (2, [(1, "train", 0.5, 2)])
    deliver("1\t4\tMean train loss: 0.2", "2\t1\tValidation loss:  0.9")
    monkeypatch.setattr(jobs, "parse_losses", lambda df: df.select(F.raise_error("broken").alias("loss"), "run", "line_no", F.lit("x").alias("kind")))
    with pytest.raises(Exception):
        follow()
    monkeypatch.undo()
    stored = spark.read.parquet(f"{base}/best")
    assert [(r.run, r.best) for r in stored.collect()] == [(1, 0.5)]
    assert follow() == (4, [(1, "train", 0.2, 4), (2, "valid", 0.9, 1)])
