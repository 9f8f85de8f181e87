"""Patches from many maps: one shuffle of routes, arrays that stay where they are made, merging without rounds."""

import glob
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import volumes as CV
from tests.test_bricks import AX, maps_of, scans
from voxelframe.functions import affine as A
from voxelframe.functions import scalars as S
from voxelframe.operators import blobs as BL
from voxelframe.operators import volume as V
from voxelframe.plans import bricks as B
from voxelframe.plans import jobs as JB
from voxelframe.session import shared_dir

SPOTS = [("p0", 1, 4.5, 3.0, 5.0), ("p0", 2, 0.0, 0.4, 10.6), ("p1", 3, None, 1.0, 1.0), ("p1", 4, 2.25, 8.0, 3.0), ("p1", 5, 90.0, 0.0, 0.0)]
MM = ((1.5, 1.1, 1.2), (4, 4, 4), (6.1, 6.1, 6.1))


def spots(spark):
    return spark.createDataFrame(SPOTS, "pid string, cid int, z double, y double, x double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routes_of_patches_are_shuffled_once(spark):
    """The table of full bricks, a few rows, is sent to the routes; they meet the bricks in one shuffle."""
    vox, _ = scans(spark)
    text = plan(V.patch_pieces(spots(spark), vox, V.volume_shapes(vox), *MM))
    assert len(re.findall(r"Exchange hashpartitioning\(pid#\d+, kz#\d+, ky#\d+, kx#\d+, part#\d+, \d+\), REPARTITION_BY_NUM", text)) == 1
    assert not re.search(r"SortMergeJoin \[pid#\d+, kz#", text)


@pytest.mark.parametrize("routes", [1, 4, 4096])
def test_full_bricks_by_exact_counts(spark, routes):
    r = np.random.default_rng(3)
    rows = [(p, i, 40, 40, 40, *r.uniform(0, 36, 3).tolist()) for p, n in (("a", 30), ("b", 3), (None, 9)) for i in range(n)]
    m = A.identity()
    for i in range(3):
        m[i][3] = F.col("zyx"[i])
    cand = spark.createDataFrame(rows, "pid string, cid int, nz int, ny int, nx int, z double, y double, x double")
    maps = cand.select("pid", "cid", "nz", "ny", "nx", *A.to_columns(m))
    want = {}
    for p, _, *_, z, y, x in rows:
        for k in {(int(a // 8), int(b // 8), int(c // 8)) for a in (z, min(z + 2, 39)) for b in (y, min(y + 2, 39)) for c in (x, min(x + 2, 39))}:
            want[p, *k] = want.get((p, *k), 0) + 1
    rows_ = B._map_rows(maps, ["cid"], [F.lit(3)] * 3, "pid", "m")
    got = {(x.pid, x.kz, x.ky, x.kx): x.copies for x in B._full_bricks(rows_, "pid", 1, 8, [3] * 3, routes).collect()}
    assert got == {k: -(-n // routes) for k, n in want.items() if n > routes and k[0] is not None}


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("edge, block", [(32, 16), (4, 3)])
def test_straight_maps_equal_the_long_form(spark, order, edge, block):
    """Maps along the axes take a way of their own; voxels on the far side, outside and of empty slots included."""
    vox, _ = scans(spark)
    cand = spots(spark).join(V.volume_shapes(vox), "pid")
    m = A.patch_map([F.col(c) for c in AX], *MM)
    maps = cand.select("pid", "cid", "nz", "ny", "nx", *A.to_columns(m))
    source = A.apply(A.from_columns(), [F.col(c).cast("double") for c in AX])
    long_ = V.resample(V.grid(maps, (4, 4, 4)), vox, ["cid", *AX], source, [F.col(f"n{c}") for c in AX], order)
    want = {(r.cid, r.z, r.y, r.x): r.v for r in long_.collect()}
    pieces = B.resample_affine(B.brick_pieces(vox, edge=edge), maps, ["cid"], (4, 4, 4), order=order, edge=edge, block=block, packed=True, change=lambda v: v + 1)
    got = {r.cid: np.array(r.v).reshape(4, 4, 4) - 1 for r in B.whole_grids(pieces, ["cid"]).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and len(want) == 5 * 64
    assert max(abs(got[c][z, y, x] - v) for (c, z, y, x), v in want.items()) < 1e-9 and any(want.values())


@pytest.mark.parametrize("edge, block", [(32, 16), (4, 3)])
def test_whole_patches_stay_where_they_are_made(spark, edge, block):
    shapes = ((9, 7, 11), (5, 12, 6))
    vox, _ = scans(spark)
    maps, bricks = maps_of(spark, shapes), B.brick_pieces(vox, edge=edge)
    placed = B.dealt(bricks, maps, ["cid"], (6, 5, 7), edge=edge, block=block)
    every, whole, parts = (B.resample_affine(bricks, maps, ["cid"], (6, 5, 7), edge=edge, block=block, packed=k, placed=placed) for k in (True, "whole", "parts"))
    assert (parts.count() == 0) == (edge == 32) and whole.filter("size(places) > 0").count() == 0
    want = {(r.pid, r.cid): r.v for r in B.whole_grids(every, ["cid"]).collect()}
    both = whole.select("pid", "cid", "v").unionByName(B.whole_grids(parts, ["cid"]))
    rows = both.collect()
    assert {(r.pid, r.cid): r.v for r in rows} == want and len(rows) == len(want)
    assert edge == 32 or "ReusedExchange" in plan(both)  # routes and bricks are shuffled once for both kinds


def test_candidate_patches_as_one_array_each(spark):
    vox, _ = scans(spark)
    args = (spots(spark), vox, V.volume_shapes(vox), *MM)
    want = {r.cid: r.v for r in B.whole_grids(V.patch_pieces(*args, change=S.hu_norm_array), ["cid"]).collect()}
    assert {r.cid: r.v for r in V.whole_patches(*args, change=S.hu_norm_array).collect()} == want and len(want) == 5


def test_norm_of_arrays_and_sums_of_pieces(spark):
    values = [-2000.0, -1000.0, -999.5, 0.0, 37.25, 400.0, 1e9, float("nan"), float("inf"), float("-inf")]
    want = [r.v for r in spark.createDataFrame([(x,) for x in values], "x double").select(S.hu_norm("x").alias("v")).collect()]
    assert S.hu_norm_array(np.array(values)).tolist() == want
    vox, _ = scans(spark)
    cand = spots(spark).withColumn("d", F.lit(1.0)).withColumnRenamed("cid", "aid")
    args = (cand, vox.withColumnRenamed("v", "hu"), V.volume_shapes(vox), *MM)
    rows = {(r.aid, r.pz, r.py, r.px): r.v for r in JB.patches(*args).collect()}
    pieces = JB.patch_pieces(*args)
    assert "transform(" not in plan(pieces)
    got = {r.aid: r for r in CV.piece_sums(pieces, "v", "aid").collect()}
    for aid in range(1, 6):
        mine = {k[1:]: v for k, v in rows.items() if k[0] == aid}
        assert got[aid].n == len(mine) == 64 and got[aid].mean == pytest.approx(sum(mine.values()) / 64)
        assert got[aid].moment == pytest.approx(sum((z * 16 + y * 4 + x) * v for (z, y, x), v in mine.items()) / 64)


def test_sums_of_parts_of_a_patch(spark):
    rows = [("a", 1, [3, 5], [2.0, 4.0]), ("a", 1, [0], [7.0]), ("a", 2, [], [1.0, 2.0, 3.0])]
    got = {r.cid: (r.n, r.mean, r.moment) for r in CV.piece_sums(spark.createDataFrame(rows, "pid string, cid int, places array<int>, hu array<double>")).collect()}
    assert got == {1: (3, 13 / 3, 26 / 64), 2: (3, 2.0, 8 / 64)}


def test_patients_of_one_block_are_merged_without_rounds(spark, monkeypatch):
    def never(*_):
        raise AssertionError("rounds")

    monkeypatch.setattr(BL, "_merged_in_rounds", never)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = [(p, i, 0.0, 9.0 * i, 0.0, 0.01 * i) for p in ("a", None) for i in range(40)]
        kept_files = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/**/rdd-*", recursive=True))
        got = BL.merge_close(spark.createDataFrame(rows, "pid string, cid long, z double, y double, x double, p double"), cells=1)
        made = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/**/rdd-*", recursive=True)) - kept_files
        assert {(r.pid, r.cid) for r in got.collect()} == {(p, 39) for p in ("a", None)}
        assert len(made) <= 2  # buckets and blocks; the table before the buckets is gone
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
