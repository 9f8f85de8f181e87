"""Whole stages resume and leave stored results alone."""

from pyspark.sql import functions as F

from voxelframe.operators import volume as V
from voxelframe.operators.scoring import LinearSigmoid
from voxelframe.plans import jobs as JB
from voxelframe.plans import stages as ST


def grid(spark, pids=(1, 2, 3), n=6):
    return spark.range(len(pids) * n**3).select(
        F.element_at(F.array(*map(F.lit, pids)), (F.col("id") % len(pids) + 1).cast("int")).cast("long").alias("pid"),
        *[(F.floor(F.col("id") / (len(pids) * n**k)) % n).cast("int").alias(c) for k, c in enumerate("xyz")],
    ).withColumn("hu", ((F.col("z") * 31 + F.col("y") * 17 + F.col("x") * 7 + F.col("pid")) % 13 * 100 - 900).cast("double"))


def test_scores_of_patients_to_do(spark):
    vox = grid(spark)
    shapes = vox.select("pid", *[F.lit(6).alias(f"n{c}") for c in "zyx"]).distinct()
    cand = spark.createDataFrame([(p, 10 * p + i, 1.0 + 3 * i, 2.0, 3.0) for p in (1, 2, 3) for i in range(2)], "pid long, cid long, z double, y double, x double")
    model = LinearSigmoid([0.1] * 8, 0.0)
    done = spark.createDataFrame([(2,)], "pid long")

    def run(**kw):
        return ST.stage_scores(cand, vox, shapes, (1.0, 1.0, 1.0), (2, 2, 2), (2.0, 2.0, 2.0), model, distance=1.0, **kw).collect()

    everyone, rest = run(), run(done=done)
    assert {r.pid for r in rest} == {1, 3} and sorted(rest) == sorted(r for r in everyone if r.pid != 2)
    assert {(r.pid, r.rank) for r in everyone} == {(p, k) for p in (1, 2, 3) for k in (1, 2)}
    twice = run(n_replicas=3, reach=0.4)
    assert {r.n_replicas for r in twice} == {3} and len(twice) == 6
    assert run(done=cand.select("pid")) == []


def test_scores_never_make_rows_of_patch_voxels(spark, monkeypatch):
    vox = grid(spark)
    shapes = vox.select("pid", *[F.lit(6).alias(f"n{c}") for c in "zyx"]).distinct()
    cand = spark.createDataFrame([(p, 10 * p + i, 1.0 + 3 * i, 2.0, 3.0) for p in (1, 2, 3) for i in range(2)], "pid long, cid long, z double, y double, x double")
    seen, read = [], V.resample_affine

    def watched(*args, **kw):
        seen.append(read(*args, **kw))
        return seen[-1]

    monkeypatch.setattr(V, "resample_affine", watched)
    model = LinearSigmoid([0.1] * 8, 0.0)
    assert len(ST.stage_scores(cand, vox, shapes, (1.0, 1.0, 1.0), (2, 2, 2), (2.0, 2.0, 2.0), model, distance=1.0).collect()) == 6
    assert seen[0].count() == 6


def test_candidates_of_patients_to_do(spark):
    vox = grid(spark, (1, 2), 8)
    shapes = vox.select("pid", *[F.lit(8).alias(f"n{c}") for c in "zyx"]).distinct()

    def run(**kw):
        out = ST.stage_candidates(vox, vox.filter("hu < 1e9"), shapes, (1.0, 1.0, 1.0), (7, 7, 7), (7.0, 7.0, 7.0), lambda d: d, 3, 2, min_sigma=1, max_sigma=3, threshold=0.01, **kw)
        return sorted((r.pid, round(r.z, 6), round(r.y, 6), round(r.x, 6), round(r.sigma, 6)) for r in out.collect())

    everyone = run()
    assert {r[0] for r in everyone} == {1, 2}
    assert run(done=spark.createDataFrame([(1,)], "pid long")) == [r for r in everyone if r[0] == 2]


def test_candidates_resample_scan_and_mask_once(spark, monkeypatch):
    vox = grid(spark, (1, 2), 8)
    shapes = vox.select("pid", *[F.lit(8).alias(f"n{c}") for c in "zyx"]).distinct()
    args = (shapes, (1.0, 1.0, 1.0), (7, 7, 7), (7.0, 7.0, 7.0))
    low = vox.filter("hu < 1e9 and z + y < 9 and pid + x < 8")
    seen, real = [], ST.D.detect_blobs_dog

    def watched(masked, *rest, **kw):
        seen.append(masked)
        return real(masked, *rest, **kw)

    monkeypatch.setattr(ST.D, "detect_blobs_dog", watched)
    ST.stage_candidates(vox, low, *args, lambda d: d, 3, 2, min_sigma=1, max_sigma=3, threshold=0.01)
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4  # voxels to bricks, bricks to grids
    placed = JB.masked_scan(vox, low, *args)
    want = {tuple(r) for r in placed.filter("inside and z < 6 and y < 6 and x < 6").select("pid", "z", "y", "x").collect()}
    assert 0 < len(want) < 2 * 6**3
    assert {tuple(r) for r in seen[0].select("pid", "z", "y", "x").collect()} == want
