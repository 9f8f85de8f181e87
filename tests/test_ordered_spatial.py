import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelframe.operators import joins as J
from voxelframe.operators import ranking as RK
from voxelframe.operators import slices as SL
from voxelframe.plans import ordered as O
from voxelframe.plans import spatial
from voxelframe.plans.graph import connected_components
from voxelframe.plans.pieces import map_pieces, split_pieces


def skewed(spark, n=600, seed=1):
    """A third of the rows in one group, some values missing, ties in the score."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rnd.randrange(12)}"
        rows.append((g, i, round(rnd.random(), 2), rnd.choice([None, 1.0, 2.0]), rnd.random()))
    return spark.createDataFrame(rows, "g string, i long, p double, v double, w double")


@pytest.mark.parametrize("parts", [1, 16])
def test_rank_equals_plain_window(spark, parts):
    df = skewed(spark).repartition(parts)
    out = O.rank_within(df, ["g"], [F.desc("p"), F.asc("i")], O.value_bucket(-F.col("p"), 0.1), "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("p"), "i")))
    assert sorted(out.select("i", "r").collect()) == sorted(want.select("i", "r").collect())


def test_total_rank_and_null_group(spark):
    df = skewed(spark).withColumn("g", F.when(F.col("g") != "g1", F.col("g")))
    total = O.rank_within(df, [], [F.asc("i")], O.value_bucket(F.col("i"), 37), "r").collect()
    assert all(r.r == r.i + 1 for r in total)
    grouped = O.rank_within(df, ["g"], [F.asc("i")], O.value_bucket(F.col("i"), 37), "r")
    n = df.filter("g is null").count()
    assert n > 0
    assert sorted(r.r for r in grouped.filter("g is null").collect()) == list(range(1, n + 1))


def test_running_previous_and_fill_equal_pandas(spark):
    df = skewed(spark)
    bucket = O.value_bucket(F.col("i"), 25)
    got = O.running_sum(df, ["g"], ["i"], "w", bucket, "s")
    got = O.previous_value(got, ["g"], ["i"], "w", bucket, "prev")
    got = O.forward_fill(got, ["g"], ["i"], "v", bucket, "fill").toPandas().sort_values("i").reset_index(drop=True)
    p = df.toPandas().sort_values("i").reset_index(drop=True)
    pd.testing.assert_series_equal(got["s"], p.groupby("g")["w"].cumsum(), check_names=False)
    pd.testing.assert_series_equal(got["prev"], p.groupby("g")["w"].shift(), check_names=False)
    pd.testing.assert_series_equal(got["fill"], p.groupby("g")["v"].ffill(), check_names=False)


def test_cell_join_equals_all_pairs(spark):
    rnd = random.Random(3)
    pts = [(rnd.choice("ab"), i, rnd.uniform(-20, 20), rnd.uniform(-20, 20), rnd.uniform(-20, 20)) for i in range(150)]
    pts += [("a", 1000 + i, 1.0, 1.0, 1.0) for i in range(60)]  # copies
    df = spark.createDataFrame(pts, "pid string, cid long, z double, y double, x double")
    want = {
        (a[0], a[1], b[1]) for a, b in itertools.combinations(sorted(pts, key=lambda r: r[1]), 2)
        if a[0] == b[0] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= 49
    }
    got = {(r.pid, r.i, r.j) for r in J.close_pairs(df, 7.0).collect()}
    assert got == want
    counts = {r.pid: r.n_pairs for r in J.close_pair_counts(df, 7.0).collect()}
    assert counts == {p: sum(1 for w in want if w[0] == p) for p in "ab"}


@pytest.mark.parametrize("find", ["pairs", "counts"])
def test_distance_joins_copy_few_rows(spark, monkeypatch, find):
    rnd = random.Random(4)
    pts = [("a", i, rnd.uniform(0, 50), rnd.uniform(0, 512), rnd.uniform(0, 512)) for i in range(400)]
    df = spark.createDataFrame(pts, "pid string, cid long, z double, y double, x double")
    seen, search = [], spatial.search_cells

    def watched(*args):
        seen.append(search(*args))
        return seen[-1]

    monkeypatch.setattr(spatial, "search_cells", watched)
    got = J.close_pairs(df, 40.0).count() if find == "pairs" else J.close_pair_counts(df, 40.0).first().n_pairs
    assert got == sum(sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= 1600 for a, b in itertools.combinations(pts, 2))
    assert seen[0].count() <= 4 * len(pts)


def test_close_pairs_carry_columns_of_both(spark):
    pts = [("a", 2, 0.0, 0.0, 0.0, 0.2), ("a", 1, 1.0, 0.0, 0.0, 0.1), ("a", 3, 1.0, 0.0, 0.0, 0.3), ("a", 3, 2.0, 0.0, 0.0, 0.4)]
    df = spark.createDataFrame(pts, "pid string, cid long, z double, y double, x double, s double")
    got = sorted((r.i, r.j, r.dist, r.i_s, r.j_s) for r in J.close_pairs(df, 1.0, keep=["s"]).collect())
    assert got == [(1, 2, 1.0, 0.1, 0.2), (1, 3, 0.0, 0.1, 0.3), (1, 3, 1.0, 0.1, 0.4), (2, 3, 1.0, 0.2, 0.3)]


def test_nearest_match_ties_and_reach(spark):
    blobs = spark.createDataFrame(
        [("a", 5, 0.0, 0.0, 0.0), ("a", 3, 0.0, 0.0, 0.0), ("a", 9, 0.0, 0.0, 4.0)], "pid string, cid long, z double, y double, x double"
    )
    marks = spark.createDataFrame(
        [("a", 1, 0.0, 0.0, 2.0, 4.0), ("a", 2, 0.0, 0.0, 9.0, 10.0), ("a", 3, 0.0, 0.0, 9.0, 9.0), ("b", 4, 0.0, 0.0, 0.0, 9.0)],
        "pid string, aid long, z double, y double, x double, d double",
    )
    got = {r.aid: r.cid for r in J.match_nearest(marks, blobs).collect()}
    assert got == {1: 3, 2: 9}


def union_find(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {a: find(a) for a in parent}


@pytest.mark.parametrize("kind", ["random", "path", "hub"])
def test_connected_components(spark, kind):
    rnd = random.Random(5)
    if kind == "random":
        edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    elif kind == "path":
        order = list(range(120))
        rnd.shuffle(order)
        edges = list(zip(order, order[1:]))
    else:
        edges = [(77, i) for i in range(200) if i != 77] + [(300, 301)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == union_find(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_pieces_stay_whole_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = skewed(spark).select("g", "i")

        def fn(pdf):
            return pd.concat([pd.DataFrame({"g": [g["g"].iloc[0]], "n": [len(g)]}) for g in split_pieces(pdf, ["g"])])

        out = map_pieces(df, ["g"], ["i"], fn, "g string, n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted((r.g, r.n) for r in out) == sorted((r.g, r["count"]) for r in df.groupBy("g").count().collect())


def test_asof_lookup_counts_equal_index(spark):
    rows = spark.createDataFrame([("a", i) for i in range(0, 50, 5)], "g string, i long")
    steps = spark.createDataFrame([("a", 3, 1.0), ("a", 10, 2.0), ("a", 31, 3.0)], "g string, i long, rate double")
    got = {r.i: r.rate for r in J.asof_lookup(rows, steps, ["g"], "i", "rate", 7).collect()}
    assert got == {0: None, 5: 1.0, 10: 2.0, 15: 2.0, 20: 2.0, 25: 2.0, 30: 2.0, 35: 3.0, 40: 3.0, 45: 3.0}


def test_equal_scores_of_one_patient_are_cut(spark):
    """A million equal scores of one patient: no bucket holds most of them, and the ranks are those of one sort."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("pid"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("cid"), F.lit(0.5).alias("p"))
    df = df.unionByName(spark.range(1000).select(F.lit("b").alias("pid"), F.col("id").alias("cid"), (F.col("id") % 3).cast("double").alias("p")))
    buckets = O.range_buckets(df, ["pid"], [F.desc("p"), F.asc("cid")])
    sizes = [r["n"] for r in buckets.groupBy(O.BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == n + 1000 and max(sizes) < 0.45 * n and len(sizes) == 4
    ranked = RK.rank_candidates(df)
    assert ranked.filter("pid = 'a' and rank <> cid + 1").count() == 0
    b = {r.cid: r["rank"] for r in ranked.filter("pid = 'b'").collect()}
    order = sorted(range(1000), key=lambda i: (-(i % 3), i))
    assert b == {c: k + 1 for k, c in enumerate(order)}


def test_a_series_of_a_million_slices(spark):
    n = 1_000_000
    slices = spark.range(n).select(F.lit("a").alias("pid"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("sid")).withColumn("position_mm", F.floor(F.col("sid") / 2) * 2.0)
    ordered = SL.order_slices(slices)
    assert ordered.filter(F.col("slice_no") != F.col("sid")).count() == 0
    odd = F.col("sid") % 2 == 1
    assert ordered.filter(~F.col("gap").eqNullSafe(F.when(odd, 0.0).when(F.col("sid") > 0, 2.0))).count() == 0
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Window" in x and "[pid" in x and O.BUCKET not in x and "__before" not in x and "__carry" not in x]


def test_previous_of_nulls_and_single_rows(spark):
    rows = [("a", 1, None), ("a", 2, 5.0), ("a", 3, None), (None, 1, 2.0), (None, 2, 7.0), ("c", 9, 1.0)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = sorted((str(r.g), r.i, r["rank"], r.previous) for r in O.rank_and_previous(df, ["g"], ["i"], "v").collect())
    assert got == [("None", 1, 1, None), ("None", 2, 2, 2.0), ("a", 1, 1, None), ("a", 2, 2, None), ("a", 3, 3, 5.0), ("c", 9, 1, None)]
    assert O.rank_and_previous(df.limit(0), ["g"], ["i"], "v").collect() == []
