import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import affine as A
from voxelframe.operators import components as C
from voxelframe.operators import morphology as M
from voxelframe.operators import scalespace as SS
from voxelframe.operators import volume as V
from voxelframe.plans import detection as D

AX = ["z", "y", "x"]


def table(spark, array, pid="a", name="m"):
    rows = [(pid, *map(int, i), float(v)) for i, v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, f"pid string, z int, y int, x int, {name} double")


def sparse(spark, mask, pid="a"):
    rows = [(pid, *map(int, i)) for i in np.argwhere(mask)]
    return spark.createDataFrame(rows, "pid string, z int, y int, x int")


def voxels(df):
    return {(r.z, r.y, r.x) for r in df.collect()}


def cells(mask):
    return {tuple(map(int, i)) for i in np.argwhere(mask)}


def shapes(spark, shape, pid="a"):
    return spark.createDataFrame([(pid, *shape)], "pid string, nz int, ny int, nx int")


def random_mask(shape, share, seed):
    return np.random.default_rng(seed).random(shape) < share


def brute_disk(m, r, largest):
    out = np.zeros_like(m)
    nz, ny, nx = m.shape
    for z, y, x in itertools.product(range(nz), range(ny), range(nx)):
        near = [
            m[z, y + dy, x + dx] for dy in range(-r, r + 1) for dx in range(-r, r + 1)
            if dy * dy + dx * dx <= r * r and 0 <= y + dy < ny and 0 <= x + dx < nx
        ]
        out[z, y, x] = max(near) if largest else min(near)
    return out


@pytest.mark.parametrize("r", [1, 2, 5])
def test_disk_filters(spark, r):
    m = np.random.default_rng(r).integers(0, 9, (2, 9, 8)).astype(float)
    df = table(spark, m)
    for largest in (True, False):
        got = {(q.z, q.y, q.x): q.m for q in M.disk_extreme(df, "m", r, largest).collect()}
        want = brute_disk(m, r, largest)
        assert all(got[i] == want[i] for i in got) and len(got) == m.size


def test_opening_inside_mask_inside_closing(spark):
    m = random_mask((2, 12, 12), 0.6, 4).astype(float)
    df = table(spark, m)
    opened = voxels(M.open_disk(df, "m", 2).filter("m > 0"))
    closed = voxels(M.close_disk(df, "m", 2).filter("m > 0"))
    assert opened <= cells(m) <= closed


def test_cube_opening_is_union_of_cubes(spark):
    m = random_mask((5, 5, 5), 0.8, 7)
    p = np.pad(m, 1, constant_values=True)  # outside counts as set
    want = np.zeros_like(p)
    for z, y, x in itertools.product(range(6), repeat=3):
        # anchors inside the grid only
        anchor = (z, y, x)
        if all(0 <= c < 5 for c in anchor) and p[z : z + 2, y : y + 2, x : x + 2].all():
            want[z : z + 2, y : y + 2, x : x + 2] = True
    got = voxels(M.opening(sparse(spark, m), M.cube_offsets(2), (5, 5, 5)))
    assert got == cells(want[1:-1, 1:-1, 1:-1])


def flood(mask, offsets):
    seen, out = set(), {}
    for start in sorted(map(tuple, np.argwhere(mask))):
        if start in seen:
            continue
        stack = [start]
        seen.add(start)
        while stack:
            at = stack.pop()
            out[tuple(map(int, at))] = tuple(map(int, start))
            for o in offsets:
                to = tuple(np.add(at, o))
                if all(0 <= c < n for c, n in zip(to, mask.shape)) and mask[to] and to not in seen:
                    seen.add(to)
                    stack.append(to)
    return out


def code(v):
    return (v[0] << 40) + (v[1] << 20) + v[2]


@pytest.mark.parametrize("brick", [2, 3, 64])
def test_label_volume_any_brick(spark, brick):
    m = random_mask((7, 6, 8), 0.25, 11)
    want = flood(m, M.neighbour_offsets(3))
    got = {(r.z, r.y, r.x): r.label for r in C.label_volume(sparse(spark, m), brick=brick).collect()}
    assert got == {k: code(v) for k, v in want.items()}


@pytest.mark.parametrize("diagonal", [True, False])
def test_label_slices(spark, diagonal):
    m = random_mask((9, 7, 7), 0.5, 13)
    offsets = [o for o in M.neighbour_offsets(2 if diagonal else 1) if o[0] == 0]
    want = flood(m, offsets)
    both = sparse(spark, m).unionByName(sparse(spark, m, "b"))
    got = C.label_slices(both, diagonal=diagonal, slab=4).collect()
    for pid in "ab":
        assert {(r.z, r.y, r.x): r.label for r in got if r.pid == pid} == {k: code(v) for k, v in want.items()}


def test_holes_and_borders(spark):
    ring = np.zeros((1, 5, 5))
    ring[0, 1:4, 1:4] = 1
    ring[0, 2, 2] = 0
    full = voxels(C.fill_holes(table(spark, ring), F.col("m") > 0, 5, 5))
    assert full == cells(ring) | {(0, 2, 2)}
    touching = ring.copy()
    touching[0, 0, 0] = 1  # meets the ring's corner diagonally
    assert voxels(C.clear_border(sparse(spark, touching), 5, 5)) == set()
    assert voxels(C.clear_border(sparse(spark, ring), 5, 5)) == cells(ring)


def brute_hull(pixels):
    """Pixels whose centre is in the hull of the diamonds, by half planes."""
    pts = [(y + a, x + b) for y, x in pixels for a, b in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]
    inside = set()
    ys, xs = [p[0] for p in pts], [p[1] for p in pts]
    for y in range(math.floor(min(ys)), math.ceil(max(ys)) + 1):
        for x in range(math.floor(min(xs)), math.ceil(max(xs)) + 1):
            # outside when some direction separates the centre from all points
            angles = [math.atan2(p[0] - y, p[1] - x) for p in pts if p != (y, x)]
            if len(angles) < len(pts):
                inside.add((y, x))
                continue
            angles.sort()
            gaps = [b - a for a, b in zip(angles, angles[1:] + [angles[0] + 2 * math.pi])]
            if max(gaps) <= math.pi + 1e-9:
                inside.add((y, x))
    return inside


def test_convex_hull(spark):
    rnd = random.Random(17)
    m = np.zeros((6, 9, 10), dtype=bool)
    for z in range(6):
        for _ in range(z + 1):
            m[z, rnd.randrange(9), rnd.randrange(10)] = True
    got = voxels(C.convex_hull(sparse(spark, m)))
    want = {(z, y, x) for z in range(6) for y, x in brute_hull([tuple(p) for p in np.argwhere(m[z])])}
    assert got == want
    assert cells(m) <= got


def walk_overlap(m, min_pixels, min_share):
    m = m.copy()
    mid = m.shape[0] // 2
    for step, order in ((1, range(mid, m.shape[0] - 1)), (-1, range(mid, 0, -1))):
        for z in order:
            regions = {}
            for v, root in flood(m[z + step][None], [o for o in M.neighbour_offsets(2) if o[0] == 0]).items():
                regions.setdefault(root, []).append(v)
            for members in regions.values():
                hit = sum(m[z, y, x] for _, y, x in members)
                if hit < min_pixels or hit / len(members) < min_share:
                    for _, y, x in members:
                        m[z + step, y, x] = False
    return m


@pytest.mark.parametrize("limits", [(1, 0.2), (3, 0.015), (2, 0.5)])
def test_overlap_pruning_equals_walk(spark, limits):
    m = random_mask((11, 8, 8), 0.35, 19)
    got = voxels(C.prune_by_overlap(sparse(spark, m), 5, *limits))
    assert got == cells(walk_overlap(m, *limits))


@pytest.mark.parametrize("min_area, cut_out", [(30, True), (100, False)])
def test_lung_mask_region_by_hand(spark, min_area, cut_out):
    """Two air blocks joined by a wall are the lung; an island between them is cut from its hull if large."""
    x = np.zeros((16, 24, 16))
    x[2:12, 3:7, 3:13] = -900
    x[2:12, 17:21, 3:13] = -900
    x[2:12, 3:21, 3:5] = -900
    x[5:9, 10:14, 8:12] = -900
    got = voxels(D.lung_mask_region(table(spark, x, name="hu"), shapes(spark, x.shape), min_area=min_area, brick=5))
    lung = x.copy()
    lung[5:9, 10:14, 8:12] = 0
    assert cells(lung < -350) <= got
    assert (6, 8, 10) in got  # the hull closes the gap between the blocks
    assert ((6, 12, 10) in got) is not cut_out
    assert ((6, 12, 7) in got) is not cut_out  # the island is cut with its rim
    assert got <= cells(np.pad(np.ones((10, 18, 10)), ((2, 4), (3, 3), (3, 3))))


# --- scale space -----------------------------------------------------------------------------


def test_sigma_lists():
    s = SS.dog_sigmas(1, 15)
    assert len(s) == 7 and s[-1] > 15 and abs(s[1] / s[0] - 1.6) < 1e-12
    assert SS.log_sigmas(1, 3, 3) == [1.0, 2.0, 3.0]
    assert np.allclose(SS.log_sigmas(1, 100, 3, True), [1, 10, 100])


def dense_space(img, sigmas, form):
    def along(a, s, d, axis):
        return np.apply_along_axis(lambda v: SS.smoothing_matrix(len(v), s, d) @ v, axis, a)

    def gauss(s, orders=(0, 0, 0)):
        out = img
        for axis, d in enumerate(orders):
            out = along(out, s, d, axis)
        return out

    if form == "log":
        return [-(gauss(s, (2, 0, 0)) + gauss(s, (0, 2, 0)) + gauss(s, (0, 0, 2))) * s**2 for s in sigmas]
    g = [gauss(s) for s in sigmas]
    return g if form == "gauss" else [(a - b) * s for a, b, s in zip(g, g[1:], sigmas)]


def test_mirrored_border_and_mass():
    m = SS.smoothing_matrix(5, 2.0)
    assert np.allclose(m.sum(axis=1), 1) and np.allclose(m, m.T)
    assert np.allclose(SS.smoothing_matrix(5, 2.0, 2) @ np.ones(5), SS.kernel(2.0, 2).sum())


@pytest.mark.parametrize("form", ["gauss", "dog", "log"])
@pytest.mark.parametrize("slab", [1, 3, 16])
def test_scale_space_pieces(spark, form, slab):
    img = np.random.default_rng(23).random((5, 7, 6))
    sigmas = [0.7, 1.3, 2.0]
    want = dense_space(img, sigmas, form)
    df = SS.scale_space(table(spark, img, name="v"), shapes(spark, img.shape), sigmas, form, slab=slab)
    got = {(r.level, r.z, r.y, r.x): r.v for r in df.collect()}
    assert len(got) == len(want) * img.size
    assert all(abs(v - want[k[0]][k[1:]]) < 1e-12 for k, v in got.items())
    space = np.stack(want, axis=3)
    padded = np.pad(space, 1, constant_values=-np.inf)
    top = np.max([padded[tuple(slice(1 + o, 1 + o + n) for o, n in zip(off, space.shape))] for off in itertools.product((-1, 0, 1), repeat=4)], axis=0)
    peaks = {tuple(map(int, i)) for i in np.argwhere((space == top) & (space > 0.01))}
    found = SS.local_maxima(table(spark, img, name="v"), shapes(spark, img.shape), sigmas, form, 0.01, slab=slab)
    assert {(r.z, r.y, r.x, r.level) for r in found.collect()} == peaks


def test_bright_spot_is_found(spark):
    img = np.zeros((9, 9, 9))
    img[4, 4, 4] = 5.0
    b = D.detect_blobs_dog(table(spark, img, name="v"), shapes(spark, img.shape), 1, 3, threshold=0.05).collect()
    assert [(r.z, r.y, r.x, r.sigma) for r in b] == [(4.0, 4.0, 4.0, 1.0)]


# --- geometry --------------------------------------------------------------------------------


def test_affine_inverse_and_rotation():
    m = A.patch_map([3.0, 4.0, 5.0], [2.5, 0.7, 0.7], (8, 8, 8), (12.0, 12.0, 12.0), rotation=[10.0, 20.0, -5.0], translation=[1.0, 2.0, 3.0])
    assert np.allclose(np.array(A.product(m, A.inverse(m))), np.eye(4))
    r = np.array(A.affine(rotation=[30.0, -40.0, 75.0]))[:3, :3]
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
    about_z = np.array(A.affine(rotation=[90.0, 0.0, 0.0]))
    assert np.allclose(about_z[:3, :3], [[1, 0, 0], [0, 0, -1], [0, 1, 0]])
    # without augmentation the patch centre maps to the point itself
    plain = np.array(A.patch_map([3.0, 4.0, 5.0], [2.5, 0.7, 0.7], (8, 8, 8), (12.0, 12.0, 12.0)))
    assert np.allclose(plain @ [4, 4, 4, 1], [3, 4, 5, 1])


def test_resample_identity_shift_and_outside(spark):
    img = np.arange(27, dtype=float).reshape(3, 3, 3)
    vox = table(spark, img, name="v")
    targets = spark.createDataFrame(
        [("a", 0, 1.0, 1.0, 1.0), ("a", 1, 1.0, 1.0, 1.5), ("a", 2, 2.0, 2.0, 2.0), ("a", 3, 2.1, 0.0, 0.0), ("a", 4, -0.1, 0.0, 0.0), ("a", 5, 0.5, 0.5, 0.5)],
        "pid string, t int, sz double, sy double, sx double",
    )
    n = [F.lit(3)] * 3
    out = V.resample(targets, vox, ["t"], [F.col(f"s{c}") for c in AX], n)
    got = {r.t: r.v for r in out.collect()}
    assert got == {0: 13.0, 1: 13.5, 2: 26.0, 3: 0.0, 4: 0.0, 5: 6.5}
    near = V.resample(targets, vox, ["t"], [F.col(f"s{c}") for c in AX], n, order=0)
    assert {r.t: r.v for r in near.collect()}[1] == 14.0


def test_tiles_and_stitch(spark):
    img = np.random.default_rng(1).random((10, 10, 10))
    tiles = V.tile(table(spark, img, name="v"), (10, 10, 10), 4, 3)
    assert tiles.select("tz").distinct().count() == 3
    back = {(r.z, r.y, r.x): r.v for r in V.stitch(tiles, (10, 10, 10), 4, 3).collect()}
    assert len(back) == 729 and all(img[k] == v for k, v in back.items())
    assert V.n_windows(416, 160, 128) == 3
    assert V.sliding_counts((64, 65, 48), 48, 16) == [1, 2, 0]


def test_rasterise_clips_and_rounds(spark):
    p = spark.createDataFrame([("a", 0.5, 2.5, 2.0, 2.0), ("a", 9.0, 9.0, 9.0, 2.0)], "pid string, z double, y double, x double, d double")
    got = voxels(V.rasterise(p, (5, 5, 5), "sphere"))
    assert got == {(0, 2, 2), (1, 2, 2), (0, 1, 2), (0, 3, 2), (0, 2, 1), (0, 2, 3)}
