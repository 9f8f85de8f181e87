import math
import random

import pytest
from pyspark.sql import functions as F

from voxelframe import schemas
from voxelframe.functions import pooling as P
from voxelframe.operators import blobs as B
from voxelframe.operators import ensemble as EN
from voxelframe.operators import filters as FL
from voxelframe.operators import joins as J
from voxelframe.operators import metrics as ME
from voxelframe.operators import sampling as SM
from voxelframe.operators import slices as SL
from voxelframe.plans import patient as PT
from voxelframe.plans.ordered import value_bucket
from voxelframe.plans.spatial import drop_when_near_sized, search_cells
from voxelframe.session import scratch_path
from voxelframe.sources import files as SF


def overlap(a, b):
    r1, r2 = a[5] * math.sqrt(3), b[5] * math.sqrt(3)
    d = math.dist(a[2:5], b[2:5])
    if d > r1 + r2:
        return 0.0
    if d <= abs(r1 - r2):
        return 1.0
    plane = (d * d + r1 * r1 - r2 * r2) / (2 * d)  # of the common circle, from the first centre
    caps = sum(math.pi * h * h * (r - h / 3) for r, h in ((r1, r1 - plane), (r2, r2 - d + plane)))
    return caps / (4 / 3 * math.pi * min(r1, r2) ** 3)


def some_blobs(seed=2):
    rnd = random.Random(seed)
    rows = [
        (rnd.choice("ab"), i, *[float(rnd.randrange(0, 24)) for _ in range(3)], rnd.choice([1.0, 1.6, 2.56, 4.096])) for i in range(90)
    ]
    rows += [("a", 500 + i, 5.0, 5.0, 5.0, 1.6) for i in range(40)]  # a heap of copies
    return rows


SCHEMA = "pid string, cid long, z double, y double, x double, sigma double"


def test_prune_equals_pair_loop(spark):
    rows = some_blobs()
    dead = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and overlap(a, b) > 0.3:
                dead.add(b[1] if a[5] > b[5] else a[1])
    got = {r.cid for r in B.prune(spark.createDataFrame(rows, SCHEMA), 0.3, width=9.0).collect()}
    assert got == {r[1] for r in rows} - dead


def test_prune_of_blobs_of_all_sizes(spark):
    """Sigmas from 0 to 50: every pair loop result, whatever the width of the finest grid."""
    rnd = random.Random(11)
    rows = [("a", i, *[rnd.uniform(-90, 90) for _ in range(3)], rnd.choice([0.3, 1.0, 4.0, 12.0, 50.0]) * rnd.choice([1.0, 1.0, 1.1])) for i in range(160)]
    dead = set()
    for a in rows:
        for b in rows:
            if a[1] < b[1] and overlap(a, b) > 0.3:
                dead.add(b[1] if a[5] > b[5] else a[1])
    df = spark.createDataFrame(rows, SCHEMA)
    for width in (1.0, 32.0, 500.0):
        assert {r.cid for r in B.prune(df, 0.3, width=width).collect()} == {r[1] for r in rows} - dead
    assert B.prune(df.limit(0)).collect() == []


def test_a_large_blob_fills_few_cells(spark):
    df = spark.createDataFrame([("a", 1, 3.0, 5.0, 7.0, 50.0), ("a", 2, 3.0, 5.0, 7.5, 1.0), ("a", 3, 60.0, 5.0, 7.5, 1.0)], SCHEMA)
    out = B.prune(df, 0.5)
    assert sorted(r.cid for r in out.collect()) == [1]
    rivals = df.select("pid", *[F.col(c).alias(f"o{c}") for c in "zyx"], F.col("sigma").alias("os")).filter("os = 50")
    reach = F.col("os") * (2 * math.sqrt(3))
    plan = drop_when_near_sized(df, rivals, "pid", "cid", ("z", "y", "x"), ("oz", "oy", "ox"), reach, F.col("sigma") * 2, 32.0, F.lit(True))
    joined = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in joined and "LeftSemi" in joined
    cells = search_cells(rivals, ("oz", "oy", "ox"), reach, 512.0).count()
    assert cells <= 8 < search_cells(rivals, ("oz", "oy", "ox"), reach, 32.0).count()


def test_greedy_prune_equals_sequential_loop(spark):
    rows = some_blobs(3)
    kept = []
    for a in sorted(rows, key=lambda r: (-r[5], r[2], r[3], r[4], r[1])):
        if all(a[0] != k[0] or overlap(a, k) <= 0.3 for k in kept):
            kept.append(a)
    got = {r.cid for r in B.prune_greedy(spark.createDataFrame(rows, SCHEMA), 0.3, width=9.0).collect()}
    assert got == {k[1] for k in kept}


def test_overlap_limits(spark):
    df = spark.createDataFrame([(0.0, 2.0, 1.0), (3.0, 2.0, 1.0), (5.3, 2.0, 1.0), (2.0, 2.0, 1.0), (2.0, 2.0, 2.0)], "d double, s1 double, s2 double")
    got = [r.v for r in df.select(B.blob_overlap(F.col("d"), F.col("s1"), F.col("s2")).alias("v")).collect()]
    assert got[0] == 1.0 and got[2] == 0.0
    assert got[1] == pytest.approx(overlap(("", 0, 0, 0, 0, 2.0), ("", 0, 3, 0, 0, 1.0)))
    assert 0 < got[4] < 1


@pytest.mark.parametrize("batch", ["4", "10000"])
def test_merge_close_equals_sequential_loop(spark, batch):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), i, *[rnd.uniform(0, 60) for _ in range(3)], rnd.random()) for i in range(120)]
    rows += [("a", 500 + i, 5.0, 5.0, 5.0, round(rnd.random(), 1)) for i in range(60)]
    want = set()
    for pid in "ab":
        kept = []
        for r in sorted((r for r in rows if r[0] == pid), key=lambda r: r[1]):
            near = next((k for k in kept if math.sqrt((2.5 * (r[2] - k[2])) ** 2 + (r[3] - k[3]) ** 2 + (r[4] - k[4]) ** 2) < 16), None)
            if near is None:
                kept.append(r)
            elif r[5] > near[5]:
                kept.remove(near)
                kept.append(r)
        want |= {k[1] for k in kept}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "pid string, cid long, z double, y double, x double, p double")
        got = {r.cid for r in B.merge_close(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == want


def merged(rows):
    """The sequential loop over rows (pid, cid, z, y, x, p) of one patient."""
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        near = next((k for k in kept if math.sqrt((2.5 * (r[2] - k[2])) ** 2 + (r[3] - k[3]) ** 2 + (r[4] - k[4]) ** 2) < 16), None)
        if near is None:
            kept.append(r)
        elif r[5] > near[5]:
            kept.remove(near)
            kept.append(r)
    return {k[1] for k in kept}


@pytest.mark.parametrize("cells, per_block", [(8, 20_000), (1, 20_000), (1, 9), (2, 40)])
def test_merge_close_over_blocks(spark, cells, per_block):
    """Chains of replacements across cells, and a heap that holds a third of all candidates and is cut by ids."""
    rnd = random.Random(7)
    rows = [(None, i, rnd.uniform(-20, 20), rnd.uniform(-60, 60), rnd.uniform(0, 130), round(rnd.random(), 1)) for i in range(150)]
    rows += [(None, 1000 + i, 1.0, 5.0, 15.9, rnd.random()) for i in range(90)]
    chain = [("c", i, 0.0, 0.0, 9.0 * i, 0.01 * i) for i in range(40)]
    scattered = rnd.sample(range(200), 40)
    chain += [("d", scattered[i], 0.0, 9.0 * i, 0.0, rnd.random()) for i in range(40)]
    odd = [("e", 1, None, 1.0, 1.0, 0.5), ("e", 2, 0.0, 0.0, 0.0, None), ("e", 3, 0.0, 0.0, 0.0, 0.9)]
    df = spark.createDataFrame(rows + chain + odd, "pid string, cid long, z double, y double, x double, p double").repartition(3)
    got = B.merge_close(df, cells=cells, per_block=per_block)
    assert got.columns == df.columns
    found = {(r.pid, r.cid) for r in got.collect()}
    want = {(p, c) for p in (None, "c", "d") for c in merged([r for r in rows + chain if r[0] == p])}
    assert found == want | {("e", 1), ("e", 2)}


def test_only_candidates_near_others_take_part_in_rounds(spark, monkeypatch):
    rows = [("a", i, 0.0, 40.0 * i, 0.0, 0.5) for i in range(50)] + [("a", 100, 0.0, 12.0, 0.0, 0.9), ("b", 1, 0.0, 0.0, 0.0, 0.1), ("b", 2, 0.0, 129.0, 0.0, 0.1), ("b", 3, 0.0, 127.0, 0.0, 0.2)]
    df = spark.createDataFrame(rows, "pid string, cid long, z double, y double, x double, p double")
    seen, deal = [], B.range_buckets

    def watched(*args):
        seen.append(deal(*args))
        return seen[-1]

    monkeypatch.setattr(B, "range_buckets", watched)
    got = {(r.pid, r.cid) for r in B.merge_close(df).collect()}
    assert got == {(p, c) for p in "ab" for c in merged([r for r in rows if r[0] == p])}
    assert sorted((r.pid, r.cid) for r in seen[0].collect()) == [("a", 0), ("a", 100), ("b", 2), ("b", 3)]


def test_merge_close_of_nothing(spark):
    df = spark.createDataFrame([], "pid string, cid long, z double, y double, x double, p double")
    assert B.merge_close(df).collect() == []


# --- sampling --------------------------------------------------------------------------------


def test_shards_of_21(spark):
    df = spark.range(21)
    got = SM.shards(df, 3, ["id"], value_bucket(F.col("id"), 4)).groupBy("shard").agg(F.min("id"), F.max("id"), F.count("id")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 6, 7), (2, 7, 13, 7), (3, 14, 20, 7)]
    few = SM.shards(spark.range(2), 3, ["id"], value_bucket(F.col("id"), 4)).collect()
    assert {r.shard for r in few} == {3}


def test_holdout_sizes_and_partition_independence(spark):
    df = spark.range(1000).select(F.col("id").alias("pid"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    a = SM.stratified_holdout(df.repartition(1), 0.15, "s")
    b = SM.stratified_holdout(df.repartition(16), 0.15, "s")
    assert sorted(a.collect()) == sorted(b.collect())
    counts = {(r.label, r.split): r["count"] for r in a.groupBy("label", "split").count().collect()}
    assert counts[(1, "test")] == 50 and counts[(0, "test")] == 100
    folds = SM.k_folds(df, 10, "f").groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.label == label]
        assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


def annotations(spark):
    rows = [("hot", i, 5.0 if i % 4 == 0 else 0.0) for i in range(200)] + [(f"p{i % 20}", 1000 + i, 3.0 if i % 20 == 1 else 0.0) for i in range(200)]
    return spark.createDataFrame(rows, "pid string, aid long, d double")


def test_matched_negatives(spark):
    got = SM.matched_negatives(annotations(spark), "m").groupBy("pid").agg(F.count_if(F.col("d") > 0).alias("p"), F.count_if(F.col("d") == 0).alias("n")).collect()
    assert {r.pid: (r.p, r.n) for r in got} == {"hot": (50, 50), "p1": (10, 0)}
    with pytest.raises(Exception, match="too few negatives"):
        SM.matched_negatives(annotations(spark), "m", on_short="error").collect()


def test_fixed_ratio_epoch(spark):
    ann = annotations(spark)
    got = SM.fixed_ratio_epoch(ann, 0.25, "e")
    assert got.filter("positive").count() == 60 and got.filter("not positive").count() == 180
    known = {(r.pid, r.aid) for r in ann.filter("d = 0").collect()}
    assert all((r.pid, r.aid) in known for r in got.filter("not positive").collect())


def test_balanced_stream_ratio(spark):
    df = spark.range(4000).select(F.col("id").alias("pid"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    s = SM.balanced_stream(df, "b")
    neg, pos = s.filter("label = 0").count(), s.filter("label = 1").count()
    assert neg == 3600 and 0.9 < pos / neg < 1.1


# --- guards, metrics, slices -----------------------------------------------------------------


def test_guards(spark):
    bad = spark.createDataFrame([(1, 0), (2, 7)], "pid long, label int")
    with pytest.raises(Exception, match="not 0 or 1"):
        FL.require_binary(bad).collect()
    ok, rest = FL.quarantine(bad)
    assert ok.count() == 1 and rest.count() == 1
    p = spark.createDataFrame([(1, 0.5), (3, 0.5)], "pid long, p double")
    with pytest.raises(Exception, match="one side only"):
        J.require_same_keys(p, bad).collect()
    y = spark.createDataFrame([(1, 0), (2, 1)], "pid long, label int")
    rows = [("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.5), ("b", 2, 0.5)]

    def check(predictions, labels=y, per=("config",)):
        df = spark.createDataFrame(predictions, "config string, pid long, p double")
        return J.require_same_keys(df, labels, per=per).count()

    assert check(rows) == 4
    assert check(rows[:2], per=()) == 2
    for wrong in (rows[:3], [*rows, rows[0]], [rows[0], rows[3]]):
        with pytest.raises(Exception, match="missing or repeated"):
            check(wrong)
    with pytest.raises(Exception, match="missing or repeated"):
        check([*rows[:2], rows[0]], per=())
    with pytest.raises(Exception, match="repeated label"):
        check(rows, y.union(y))
    with pytest.raises(Exception, match="missing or repeated"):
        EN.best_config(spark.createDataFrame(rows[:3], "config string, pid long, p double"), y).collect()


def test_detection_counts_patients_without_blobs(spark):
    flagged = spark.createDataFrame([(1, 7, 0.9, 1)], "pid long, cid long, p double, flag int")
    ann = spark.createDataFrame([(1,), (2,), (2,)], "pid long")
    who = spark.createDataFrame([(1,), (2,), (3,)], "pid long")
    got = ME.detection_totals(ME.detection_per_patient(flagged, ann, patients=who)).first().asDict()
    assert got == {"n_patients": 3, "tp": 1, "n_blobs": 1, "n_pos": 3, "n_missed": 1}
    assert ME.detection_totals(ME.detection_per_patient(flagged, ann)).first()["n_patients"] == 2
    top = ME.detection_in_top(flagged, ann, 5, patients=who).first().asDict()
    assert top == {"tp": 1, "n_pos": 3, "tp_top": 1, "fp_top": 14}


def test_patient_prediction_has_n_slots(spark):
    cand = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (9, 3, 1.0)], "pid long, cid long, p double")
    who = spark.createDataFrame([(1, 1), (2, 0)], "pid long, label int")
    got = {r.pid: r.prediction for r in PT.patient_predictions(cand, who, n=4, r=2.0).collect()}
    want = [math.log((math.exp(2 * 0.9) + 3) / 4 + 1e-7) / 2, math.log(1 + 1e-7) / 2]
    assert got.keys() == {1, 2} and [got[1], got[2]] == pytest.approx(want)
    with pytest.raises(Exception, match="one side only"):
        PT.patient_log_loss(PT.patient_predictions(cand, who.limit(1)), who).collect()


def test_log_loss_at_zero_and_one(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1)], "p double, label int")
    got = df.agg(ME.log_loss("p", "label")).first()[0]
    assert got == pytest.approx(-(math.log(1e-15) + math.log(1 - 1e-15)) / 2)
    assert df.agg(ME.cross_entropy("p", "label")).first()[0] < 0


def test_pools_do_not_overflow(spark):
    df = spark.createDataFrame([(800.0,), (-800.0,)], "x double")
    x = F.col("x")
    row = df.agg(P.noisy_or(x), P.one_minus_product(x), P.mean_power(x), P.sum_malignant(x)).first()
    assert list(row) == pytest.approx([1.0, 1.0, 0.5, 1.0])


def test_exact_cdf_close_to_approximation(spark):
    df = spark.createDataFrame([(3.0, 1.5)], "m double, s double")
    a = df.select(P.normal_cdf(F.col("m"), F.col("s"), 7)).first()[0]
    b = df.select(P.normal_cdf(F.col("m"), F.col("s"), 7, exact=True)).first()[0]
    assert a == pytest.approx(b, abs=2e-7) and b[3] == pytest.approx(0.5)


def series(spark, rows):
    return spark.createDataFrame(rows, "pid string, sid string, instance_number long, position_mm double")


def test_single_and_doubled_series(spark):
    single = [("a", f"s{i}", i, 2.5 * i) for i in (2, 0, 1)]
    doubled = [("b", f"t{i}", n, 2.5 * (i // 2)) for i, n in enumerate([1, 2, 4, 3, 5, 5, 9])]
    got = SL.assemble_scans(series(spark, single + doubled)).orderBy("pid", "slice_no").collect()
    assert [r.sid for r in got if r.pid == "a"] == ["s0", "s1", "s2"]
    assert [r.sid for r in got if r.pid == "b"] == ["t1", "t2", "t5"]
    assert all(r.resolved and r.spacing_z == 2.5 for r in got)


def test_principal_line_of_one_and_copies(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.0, 0.0, 5.0), ("b", 1, 0.0, 0.0, 0.0), ("b", 2, 0.0, 0.0, 0.0), ("b", 3, 0.0, 3.0, 4.0), ("b", 4, 0.0, 1.5, 2.0)],
        "pid string, sid long, mx double, my double, mz double",
    )
    got = {(r.pid, r.sid): r.line_pos for r in SL.principal_line(df).collect()}
    assert got == {("a", 1): 0.0, ("b", 1): 0.0, ("b", 2): 0.0, ("b", 3): 5.0, ("b", 4): 2.5}


# --- files -----------------------------------------------------------------------------------


def test_last_label_line_wins_across_parts(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("id,cancer\na,0\nb,1\na,1\nc,0\nb,0\n")
    got = {r.pid: r.label for r in SF.read_labels(spark, str(tmp_path / "labels.csv")).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}


def test_result_store_replaces_only_given_patients(spark):
    path = scratch_path(spark, "results")
    assert SF.generated(spark, path).count() == 0
    SF.write_results(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "pid string, v int"), path, buckets=2)
    SF.write_results(spark.createDataFrame([("b", 2), ("d", 2)], "pid string, v int"), path, buckets=2)
    got = {r.pid: r.v for r in spark.read.parquet(path).collect()}
    assert got == {"a": 1, "b": 2, "c": 1, "d": 2}
    assert {r.pid for r in SF.generated(spark, path).collect()} == set("abcd")


def test_submission_and_catalog_guards(spark):
    path = scratch_path(spark, "submission")
    df = spark.createDataFrame([("b", 0.2), ("a", 0.1)], "pid string, p double")
    SF.write_submission(df, path)
    parts = spark.read.text(path).select("value", F.input_file_name().alias("f")).collect()
    assert [r.value for r in sorted(parts, key=lambda r: r.f) if r.value != "id,cancer"] == ["a,0.1", "b,0.2"]
    catalog = spark.createDataFrame([("m", 1), ("n", 1), ("n", 2)], "config string, model int")
    one = spark.createDataFrame([("m",)], "config string")
    assert SF.lookup_one(catalog, one).count() == 1
    for name in ("n", "missing"):
        with pytest.raises(Exception, match="expected one model"):
            SF.lookup_one(catalog, spark.createDataFrame([(name,)], "config string")).collect()


def test_schema_check(spark):
    with pytest.raises(ValueError, match="missing columns: x"):
        schemas.require_columns(spark.createDataFrame([(1,)], "pid int"), "pid", "x")
