"""Work that grew faster than the tables, or wrote far more than it read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import affine as A
from voxelframe.functions import pooling as P
from voxelframe.operators import blobs as B
from voxelframe.operators import components as C
from voxelframe.operators import joins as J
from voxelframe.operators import metrics as ME
from voxelframe.operators import morphology as M
from voxelframe.operators import scalespace as SS
from voxelframe.operators import volume as V
from voxelframe.plans import bricks as BR
from voxelframe.plans import jobs as JB
from voxelframe.sources import files as SF


def shuffled(spark, df):
    """Bytes that computing the table writes to shuffles."""
    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return written() - before


def tasks(spark, run):
    """Result of a function and the tasks it started."""
    def started():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalTasks()

    before = started()
    return run(), started() - before


def scattered(spark, side, share):
    """Voxels of one cube in no order, over 8 tasks."""
    at = F.pmod(F.col("id") * 7919, F.lit(side**3))
    rows = spark.range(0, side**3, 1, 8).filter(F.pmod(F.xxhash64("id"), F.lit(100)) < share)
    return rows.select(F.lit(1).alias("pid"), *[F.floor(at / side**k % side).cast("int").alias(c) for k, c in ((2, "z"), (1, "y"), (0, "x"))])


def as_set(df):
    return sorted((r.pid, r.z, r.y, r.x) for r in df.collect())


def brute(places, steps, n):
    grid = {(z, y, x) for z in range(n) for y in range(n) for x in range(n)}
    for offsets, grow in steps:
        if grow:
            places = {q for p in places for o in offsets if (q := tuple(a + b for a, b in zip(p, o))) in grid}
        else:
            places = {p for p in grid if all((q := tuple(a + b for a, b in zip(p, o))) in places or q not in grid for o in offsets)
                      and any(tuple(a + b for a, b in zip(p, o)) in places for o in offsets)}
    return sorted((1, *p) for p in places)


@pytest.mark.parametrize("share", [3, 90])
def test_small_structures_across_bricks(spark, share):
    m = scattered(spark, 36, share).cache()
    places = {(r.z, r.y, r.x) for r in m.collect()}
    cube, near, apart = M.cube_offsets(2), M.neighbour_offsets(2), [(0, 0, 3), (1, -2, 0)]
    assert as_set(M.dilate(m, near, (36, 36, 36))) == brute(places, [(near, True)], 36)
    assert as_set(M.opening(m, cube, (36, 36, 36))) == brute(places, [(cube, False), (cube, True)], 36)
    assert as_set(M.erode(m, apart, (36, 36, 36))) == brute(places, [(apart, False)], 36)
    m.unpersist()


def test_a_dilation_shuffles_voxels_and_not_offsets(spark):
    m = scattered(spark, 48, 50)
    assert shuffled(spark, M.dilate(m, M.neighbour_offsets(2), (48, 48, 48))) < 1.7 * shuffled(spark, m.repartition("pid", "z"))


@pytest.mark.parametrize("kind", ["sphere", "cube", "gauss"])
def test_union_of_shapes_is_the_union_of_their_masks(spark, kind):
    u = [F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000 for s in "zyxd"]
    few = spark.range(60).select((F.col("id") % 2).alias("pid"), *[(c * 44 - 2).alias(a) for c, a in zip(u, "zyx")], (u[3] * 9).alias("d"))
    many = spark.range(9000).select(F.lit(3).cast("long").alias("pid"), *[(c * 44 - 2).alias(a) for c, a in zip(u, "zyx")], (u[3] * 4).alias("d"))
    none = spark.createDataFrame([(4, None, 1.0, 1.0, 2.0), (5, 1.0, 1.0, 1.0, None), (6, 1.0, 1.0, 1.0, -9.0)], few.schema)
    p = few.unionByName(many).unionByName(none)
    shape = (40, F.lit(36), 33)
    got = {(r.pid, r.z, r.y, r.x): r.v for r in V.rasterise_union(p, shape, kind).collect()}
    want = {(r.pid, r.z, r.y, r.x): r.v for r in V.union_masks(V.rasterise(p.dropna(), shape, kind)).collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=0, atol=1e-12)


def test_crps_without_lambda_steps(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1.2, 0.5, 2.0), (3.0, 0.0, 3.0), (-4.0, 2.5, 9.5), (1.0, 1.0, None), (None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, nan), (nan, 1.0, 1.0), (inf, 1.0, 2.0), (1.0, 1.0, -inf)],
        "m double, s double, t double",
    )
    m, s, t = (F.col(c) for c in "mst")
    squares = F.zip_with(P.normal_cdf(m, s, 7), P.heaviside(t, 7), lambda a, b: (a - b) * (a - b))
    spelled = F.aggregate(squares, F.lit(0.0), lambda a, v: a + v) / F.lit(7.0)
    fast = ME.crps(m, s, t, 7)
    rows = df.select(spelled.alias("a"), fast.alias("b")).collect()
    for a, b in rows:
        assert (a is None) == (b is None) and (a is None or np.isclose(a, b, rtol=0, atol=1e-14, equal_nan=True))
    plan = df.select(fast)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_a_slab_takes_many_planes_at_once():
    slab = SS.Slab((5, 3, 4), 0, 2, 1, "float64")
    z, y, x = np.array([0, 1, 1, 4, 1]), np.array([2, 0, 0, 0, 1]), np.array([3, 1, 1, 0, 0])
    slab.add(z, y << 16 | x, np.array([1.0, 2.0, 3.0, 4.0, 5.0]))
    want = np.zeros((4, 3, 4))
    want[0, 2, 3], want[1, 0, 1], want[1, 1, 0] = 1, 5, 5
    assert np.array_equal(slab.img, want)


def test_many_bricks_in_one_kernel_call(spark):
    """Bricks of a few voxels are answered together, whole or in pieces."""
    vox = spark.range(210 * 50).select((F.col("id") % 50).alias("pid"), *[F.floor(F.floor(F.col("id") / 50) / k % n).cast("int").alias(c) for k, n, c in ((30, 7, "z"), (5, 6, "y"), (1, 5, "x"))], F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("v"))
    m = A.affine([0.9, 1.1, 0.8], [F.lit(4.0), F.lit(-3.0), F.lit(8.0)], [F.lit(0.3), F.lit(0.2), F.lit(-0.4)])
    maps = V.volume_shapes(vox).select("pid", "nz", "ny", "nx", *A.to_columns(m))
    one = BR.resample_affine(BR.brick_pieces(vox), maps, [], (6, 5, 4))
    for pieces in (BR.brick_pieces(vox, edge=2), BR.brick_table(vox, edge=2)):
        some = BR.resample_affine(pieces, maps, [], (6, 5, 4), edge=2, block=3)
        both = one.join(some.withColumnRenamed("v", "w"), ["pid", "z", "y", "x"], "full")
        n, off = both.agg(F.count(F.lit(1)), F.max(F.coalesce(F.abs(F.col("v") - F.col("w")), F.lit(1e9)))).first()
        assert n == 50 * 120 and off < 1e-9


def uneven(spark):
    """Four scans of different sizes with holes, one voxel beyond its scan and a scan without a size."""
    shapes = spark.createDataFrame([(1, 3, 9, 7), (2, 2, 30, 12), (3, 40, 4, 4), (4, 2, 1, 1)], "pid int, nz int, ny int, nx int")
    cells = V.grid(shapes, [F.col(f"n{c}") for c in "zyx"]).filter(F.pmod(F.xxhash64("pid", "z", "y", "x"), F.lit(10)) < 6)
    vox = cells.select("pid", "z", "y", "x", F.pmod(F.xxhash64("x", "y", "z"), F.lit(50)).cast("double").alias("v"))
    return vox.unionByName(spark.createDataFrame([(1, 9, 0, 0, 5.0), (1, 0, 20, 0, 5.0), (7, 0, 0, 0, 5.0), (2, 0, 0, -1, 5.0)], vox.schema)), shapes


def joined(vox, shapes, fill):
    full = V.grid(shapes, [F.col(f"n{c}") for c in "zyx"])
    return full.join(vox, ["pid", "z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def rows_of(df):
    return sorted(map(tuple, df.select("pid", "z", "y", "x", "nz", "ny", "nx", "v").collect()))


def test_positions_are_filled_in_slices(spark):
    vox, shapes = uneven(spark)
    dense = V.densify(vox, shapes, "v", fill=-1.0)
    assert rows_of(dense) == rows_of(joined(vox, shapes, -1.0))
    assert "Join" not in dense._jdf.queryExecution().optimizedPlan().toString()


def test_a_chain_on_small_slices_side_by_side(spark):
    vox, shapes = uneven(spark)
    dense = V.densify(vox, shapes, "v")
    steps = [(2, True), (1, False), (3, False)]
    chain = M.disk_chain(dense, "v", steps, placed=True)
    assert chain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {}
    for r in rows_of(joined(vox, shapes, 0.0)):
        want.setdefault(r[:2], {})[r[2:4]] = r[7]
    for at, values in want.items():
        for r, largest in steps:
            pick = max if largest else min
            values = {p: pick(w for q, w in values.items() if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= r * r) for p in values}
        want[at] = values
    got = {(*r[:4],): r[7] for r in rows_of(chain)}
    assert got == {(*at, *p): v for at, values in want.items() for p, v in values.items()}


def test_holes_of_many_slices_in_one_go(spark):
    vox, shapes = uneven(spark)
    dense = V.densify(vox, shapes, "v")
    marked = C.mark_filled(dense, F.col("v") > 12, F.col("ny"), F.col("nx"), placed=True)
    assert marked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    slices, got = {}, {}
    for r in marked.collect():
        slices.setdefault((r.pid, r.z), {})[r.y, r.x] = (r.v > 12, r.y in (0, r.ny - 1) or r.x in (0, r.nx - 1))
        got[r.pid, r.z, r.y, r.x] = r["__in"]
    for at, places in slices.items():
        todo = [p for p, (set_, edge) in places.items() if edge and not set_]
        out = set(todo)
        while todo:
            y, x = todo.pop()
            for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if q in places and q not in out and not places[q][0]:
                    out.add(q)
                    todo.append(q)
        assert {p: got[*at, *p] for p in places} == {p: int(p not in out) for p in places}


def scattered_blobs(spark):
    """Blobs of two patients, most of them alone, of very different sizes, some equal in place or size."""
    u = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000 for k in range(4)]
    rows = spark.range(0, 500, 1, 2).select(
        (F.col("id") % 2).alias("pid"), F.col("id").alias("cid"), *[F.floor(c * 900 - 100).cast("double").alias(a) for c, a in zip(u, "zyx")], F.floor(1 + 14 / (1 + 9 * u[3])).alias("sigma")
    )
    near = rows.filter("cid < 50").select("pid", (F.col("cid") + 5000).alias("cid"), (F.col("z") + F.col("cid") % 3).alias("z"), "y", "x", F.col("sigma"))
    return rows.unionByName(near).withColumn("sigma", F.when(F.col("cid") == 0, 90.0).otherwise(F.col("sigma").cast("double")))


def test_greedy_pruning_writes_only_outranked_blobs(spark, monkeypatch):
    rows = scattered_blobs(spark)
    written = []
    real = B.cut

    def cut(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(B, "cut", cut)
    got = {(r.pid, r.cid) for r in B.prune_greedy(rows, 0.2).collect()}
    kept = []
    for r in sorted(rows.collect(), key=lambda r: (-r.sigma, r.z, r.y, r.x, r.cid)):
        if all(q.pid != r.pid or overlap(r, q) <= 0.2 for q in kept):
            kept.append(r)
    assert got == {(r.pid, r.cid) for r in kept}
    assert sum(written[1:]) < 0.6 * written[0]


def overlap(a, b):
    d = math.dist((a.z, a.y, a.x), (b.z, b.y, b.x))
    r, s = a.sigma * math.sqrt(3), b.sigma * math.sqrt(3)
    if d > r + s:
        return 0.0
    if d <= abs(r - s):
        return 1.0
    lens = math.pi * (r + s - d) ** 2 * (d * d + 2 * d * (r + s) - 3 * (r * r + s * s) + 6 * r * s) / (12 * d)
    return lens / (4 / 3 * math.pi * min(r, s) ** 3)


def test_pruning_shuffles_blobs_and_not_cells(spark):
    rows = scattered_blobs(spark)
    both = B.prune(rows, 0.2, width=64.0)
    dead = set()
    everyone = rows.collect()
    for a in everyone:
        for b in everyone:
            if a.pid == b.pid and (b.sigma, b.cid) > (a.sigma, a.cid) and abs(a.z - b.z) < 400 and overlap(a, b) > 0.2:
                dead.add(a.cid)
                break
    assert {r.cid for r in both.collect()} == {r.cid for r in everyone} - dead
    assert "__sb__cell0" in both._jdf.queryExecution().optimizedPlan().toString()


def test_patch_windows_travel_by_blocks(spark):
    side = 20
    vox = scattered(spark, side, 60).withColumn("v", F.col("z") * 400 + F.col("y") * 20 + F.col("x"))
    u = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(26)) - 3 for k in range(3)]
    points = spark.range(0, 300, 1, 2).select(F.lit(1).alias("pid"), F.col("id").alias("cid"), *[c.cast("double").alias(a) for c, a in zip(u, "zyx")])
    found = J.patch_voxels(points, vox, 2, brick=4)
    got = sorted(map(tuple, found.select("cid", "v", "pz", "py", "px").collect()))
    places = [(r.z, r.y, r.x) for r in vox.collect()]
    want = sorted(
        (r.cid, z * 400 + y * 20 + x, int(z - r.z + 2), int(y - r.y + 2), int(x - r.x + 2))
        for r in points.collect() for z, y, x in places if all(c - 2 <= p < c + 2 for c, p in ((r.z, z), (r.y, y), (r.x, x)))
    )
    assert got == want
    assert "__block0" in found._jdf.queryExecution().optimizedPlan().toString()


def test_many_folders_take_few_tasks(spark, tmp_path):
    """Neither a task per folder to list nor one per file to look at."""
    for i in range(300):
        at = tmp_path / f"scan-{i % 7}" / f"part={i}" if i % 3 else tmp_path / f"scan={i}"
        at.mkdir(parents=True)
        if i % 10:
            (at / "a.dcm").write_bytes(b"x")
            (at / "b.dcm").write_bytes(b"")
    (tmp_path / "top.txt").write_text("x")
    want = sorted({f"file:{p.parent}" for p in tmp_path.rglob("*") if p.is_file()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        got, n = tasks(spark, lambda: [r.folder for r in SF.scan_folders(spark, str(tmp_path)).collect()])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    assert n < 60
    assert spark.conf.get(SF.LISTING_TASKS) == "10000"


def test_property_batches_read_the_annotations_once(spark):
    u = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 10 for k in range(3)]
    ann = spark.range(0, 4000, 1, 200).select(
        (F.col("id") % 90).alias("pid"), F.col("id").alias("aid"), *[c.alias(a) for c, a in zip(u, "zyx")],
        F.when((F.col("id") % 90 < 60) & (F.col("id") % 7 == 0), 3.0).otherwise(0.0).alias("d"),
    )
    stored = spark.createDataFrame(ann.collect(), ann.schema).coalesce(1).cache()
    marks = stored.filter("d > 0").select("pid", (F.col("z") + 1).alias("cz"), F.col("y").alias("cy"), F.col("x").alias("cx"), (1 + F.col("aid") % 5).cast("double").alias("m"))
    rows, n = tasks(spark, lambda: JB.property_batches(ann, marks, 8, 0.75, "t", ["nodule", "m"], {}, {"m": "bounded_continuous"}).collect())
    assert n < 500
    known = {(r.pid, r.aid): r for r in stored.collect()}
    pids = sorted(r.pid for r in rows)  # 10 batches of 6 and 2; the other patients without positives are not used
    assert pids[:60] == list(range(60)) and len(set(pids[60:])) == len(pids[60:]) == 20
    for r in rows:
        a = known[r.pid, r.aid]
        assert (r.z, r.y, r.x, r.d) == (a.z, a.y, a.x, a.d) and r.positive == (a.d > 0) == (r.pid < 60)
        near = [1 + b.aid % 5 for b in known.values() if b.pid == a.pid and b.d > 0 and math.dist((a.z, a.y, a.x), (b.z + 1, b.y, b.x)) < 5]
        assert r.target[0] == (a.d > 0) and r.enabled[1] == (a.d > 0)
        assert math.isclose(r.target[1], (sum(near) / len(near) - 1) / 4 if a.d > 0 else 0.0, abs_tol=1e-12)
    stored.unpersist()
