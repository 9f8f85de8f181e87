"""Brick volumes against the long form and plain numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import affine as A
from voxelframe.operators import volume as V
from voxelframe.plans import bricks as B

AX = ("z", "y", "x")


def scans(spark, seed=1, shapes=((9, 7, 11), (5, 12, 6)), share=0.7):
    """Sparse scans as voxel rows, and as arrays."""
    r = np.random.default_rng(seed)
    rows, images = [], {}
    for i, n in enumerate(shapes):
        img = r.integers(-900, 900, n) * (r.random(n) < share)
        images[f"p{i}"] = img
        rows += [(f"p{i}", *map(int, at), float(img[tuple(at)])) for at in np.argwhere(img)]
        rows.append((f"p{i}", *[k - 1 for k in n], 0.0))
    return spark.createDataFrame(rows, "pid string, z int, y int, x int, v double").repartition(3), images


def maps_of(spark, shapes, seed=2, per=3):
    r = np.random.default_rng(seed)
    rows = []
    for i, n in enumerate(shapes):
        for k in range(per):
            m = A.patch_map([c / 2 + float(r.normal()) for c in n], [1.5, 0.8, 1.1], (6, 5, 7), (9.0, 6.0, 8.0), rotation=[float(x) for x in r.uniform(-180, 180, 3)])
            rows.append((f"p{i}", k, *n, *[float(m[a][b]) for a in range(3) for b in range(4)]))
    rows.append(("p0", 99, *shapes[0], *[None] * 12))
    rows.append(("nobody", 5, 4, 4, 4, *[0.0] * 12))
    return spark.createDataFrame(rows, "pid string, cid int, nz int, ny int, nx int, " + ", ".join(f"m{a}{b} double" for a in range(3) for b in range(4)))


def found(df, value="v"):
    rows = df.collect()
    out = {(r.pid, r.cid, r.z, r.y, r.x): r[value] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("edge, block, routes", [(32, 16, None), (4, 3, None), (3, 2, 2)])
def test_bricks_equal_the_long_form(spark, order, edge, block, routes):
    shapes = ((9, 7, 11), (5, 12, 6))
    vox, _ = scans(spark)
    maps = maps_of(spark, shapes)
    shape = (6, 5, 7)
    targets = V.grid(maps, shape)
    source = A.apply(A.from_columns(), [F.col(c).cast("double") for c in AX])
    want = found(V.resample(targets, vox, ["cid", *AX], source, [F.col(f"n{c}") for c in AX], order))
    pieces = B.brick_pieces(vox, edge=edge)
    for bricks in (pieces, B.brick_table(vox, edge=edge)):
        got = found(B.resample_affine(bricks, maps, ["cid"], shape, order=order, edge=edge, block=block, routes=routes))
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert any(want.values())


def test_brick_table_is_dense(spark):
    vox, images = scans(spark, 3)
    e = 4
    rows = B.brick_table(vox, edge=e).collect()
    assert len({(r.pid, r.kz, r.ky, r.kx) for r in rows}) == len(rows)
    seen = dict.fromkeys(images, 0)
    for r in rows:
        img = np.pad(images[r.pid], [(0, e + 1)] * 3)
        z, y, x = r.kz * e, r.ky * e, r.kx * e
        data = np.frombuffer(r.v).reshape(e + 1, e + 1, e + 1)
        assert r["at"] is None and (data == img[z : z + e + 1, y : y + e + 1, x : x + e + 1]).all()
        seen[r.pid] += np.count_nonzero(data[:e, :e, :e])
    assert seen == {k: np.count_nonzero(v) for k, v in images.items()}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, 1, 1, 1, 5.0), (None, 1, 1, 1, 2.0), ("a", 0, 0, 0, None), ("a", 1, 0, 0, 4.0)]
    vox = spark.createDataFrame(rows, "pid string, z int, y int, x int, v double")
    m = A.identity()
    maps = spark.createDataFrame([(p, 2, 2, 2) for p in (None, "a")], "pid string, nz int, ny int, nx int").select("*", *A.to_columns(m))
    got = {(r.pid, r.z, r.y, r.x): r.v for r in B.resample_affine(B.brick_pieces(vox, edge=1), maps, [], (2, 2, 2), edge=1).collect()}
    assert len(got) == 16 and {k: v for k, v in got.items() if v} == {(None, 1, 1, 1): 7.0, ("a", 1, 0, 0): 4.0}
    assert B.resample_affine(B.brick_pieces(vox.limit(0)), maps.limit(0), [], (2, 2, 2)).collect() == []
    none = B.resample_affine(B.brick_pieces(vox.limit(0)), maps, [], (2, 2, 2)).collect()
    assert len(none) == 16 and not any(r.v for r in none)


def test_many_patches_at_one_place(spark):
    """Half of all patches read one brick: it is copied, so no task has them all."""
    vox, _ = scans(spark, 4, ((8, 8, 8),))
    m = A.patch_map([F.lit(4.0), F.lit(4.0), F.lit(4.0)], [1.0] * 3, (2, 2, 2), (2.0,) * 3)
    maps = spark.range(400).select(F.lit("p0").alias("pid"), "id", *[F.lit(8).alias(f"n{c}") for c in AX], *A.to_columns(m))
    out = B.resample_affine(B.brick_pieces(vox, edge=8), maps, ["id"], (2, 2, 2), edge=8, routes=20)
    per_task = [r["n"] for r in out.withColumn("t", F.spark_partition_id()).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per_task) == 3200 and max(per_task) <= 1600 and len(per_task) == 4
    assert out.groupBy("z", "y", "x").agg(F.count_distinct("v").alias("n")).filter("n > 1").count() == 0


def test_plan_of_a_resampled_scan(spark):
    """No row for a corner, one shuffle by scan and brick beside that of the shapes."""
    vox, _ = scans(spark)
    out = V.transform_scan(vox, V.volume_shapes(vox), [1.0] * 3, (8, 8, 8), (8.0,) * 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(pid#\d+, kz#\d+, ky#\d+, kx#\d+", plan)) == 1
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


@pytest.mark.parametrize("edge, block", [(32, 16), (4, 3)])
def test_packed_pieces_hold_the_same_patches(spark, edge, block):
    shapes = ((9, 7, 11), (5, 12, 6))
    vox, _ = scans(spark)
    maps = maps_of(spark, shapes)
    shape = (6, 5, 7)
    rows = B.resample_affine(B.brick_pieces(vox, edge=edge), maps, ["cid"], shape, edge=edge, block=block).collect()
    want = {}
    for r in rows:
        want.setdefault((r.pid, r.cid), np.zeros(shape))[r.z, r.y, r.x] = r.v
    pieces = B.resample_affine(B.brick_pieces(vox, edge=edge), maps, ["cid"], shape, edge=edge, block=block, packed=True)
    got = {(r.pid, r.cid): np.array(r.v).reshape(shape) for r in B.whole_grids(pieces, ["cid"]).collect()}
    assert got.keys() == want.keys()
    assert all(np.array_equal(got[k], want[k]) for k in want)
    assert (pieces.count() == len(want)) == (edge == 32)  # one row per patch where one brick and block hold it


def test_crops_are_the_voxels_around(spark):
    vox, images = scans(spark)
    spots = [("p0", 1, 4.5, 3.0, 5.0), ("p0", 2, 0.0, 0.4, 10.6), ("p1", 3, None, 1.0, 1.0), ("nobody", 4, 1.0, 1.0, 1.0), ("p1", 5, 90.0, 0.0, 0.0)]
    cand = spark.createDataFrame(spots, "pid string, cid int, z double, y double, x double")
    pieces = V.crop_pieces(cand, vox, V.volume_shapes(vox), 2)
    got = {r.cid: np.array(r.v).reshape(4, 4, 4) for r in B.whole_grids(pieces, ["cid"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for pid, cid, *at in spots:
        want = np.zeros((4, 4, 4))
        if pid in images and None not in at:
            padded = np.pad(images[pid], 100)
            z, y, x = (int(np.rint(c)) + 98 for c in at)
            want = padded[z:z + 4, y:y + 4, x:x + 4]
        assert np.array_equal(got[cid], want)
