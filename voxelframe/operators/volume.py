"""Voxel-table geometry: resampling, patches, rasterised shapes, tiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions import affine as A
from voxelframe.plans.bricks import EDGE, brick_pieces, dealt, origin, resample_affine, same_as_before, to_bricks, whole_grids, whole_groups
from voxelframe.session import sound_unions

AXES = ("z", "y", "x")


def grid(keys: DataFrame, shape: Sequence[int | Column], names: Sequence[str] = AXES) -> DataFrame:
    """Every grid position of every row of ``keys``."""
    out = keys
    for name, n in zip(names, shape):
        last = (n if isinstance(n, Column) else F.lit(n)) - 1
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return out


def volume_shapes(voxels: DataFrame, by: str = "pid") -> DataFrame:
    """(pid, nz, ny, nx) from the largest coordinates."""
    return voxels.groupBy(by).agg(*[(F.max(c) + 1).cast("int").alias(f"n{c}") for c in AXES])


def densify(voxels: DataFrame, shapes: DataFrame, value: str, by: str = "pid", fill: float = 0.0) -> DataFrame:
    """All grid positions, absent voxels filled: (by, z, y, x, other columns of ``shapes``, value).

    Both tables are unique by their keys. Present voxels and one row per slice meet in one shuffle and the positions are filled in there, so no
    table of all positions is shuffled or joined. The result is placed by slices, as ``morphology.by_slice`` does.
    """
    sound_unions(voxels.sparkSession)
    rest = [c for c in shapes.columns if c != by]
    slices = grid(shapes, [F.col("nz")], ["z"])
    present = voxels.filter(F.col(by).isNotNull()).select(
        F.col(by).cast(shapes.schema[by].dataType).alias(by), F.col("z").cast("int").alias("z"), F.lit(1).alias("__kind"), *[F.lit(None).cast(shapes.schema[c].dataType).alias(c) for c in rest],
        F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce(F.col(value).cast("double"), F.lit(float(fill))).alias("__v"),
    )
    heads = slices.select(by, "z", F.lit(0).alias("__kind"), *rest, F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("double").alias("__v"))
    names = [by, "z", "y", "x", *rest, value]
    r = len(rest)

    def some(b: pa.RecordBatch, head: np.ndarray, lo: int, hi: int):
        """The slices whose first rows are ``head``; their voxels stand in rows lo to hi."""
        ny, nx = (b.column(3 + rest.index(c)).take(pa.array(head)).to_numpy().astype(np.int64) for c in ("ny", "nx"))
        ends = np.cumsum(ny * nx)
        of = np.repeat(np.arange(len(head)), ny * nx)
        within = np.arange(len(of)) - np.append(0, ends[:-1])[of]
        v = np.full(len(of), float(fill))
        rows = lo + np.flatnonzero(b.column(2).slice(lo, hi - lo).to_numpy() == 1)
        y, x = (c.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[3 + r : 5 + r])
        mine = np.searchsorted(head, rows, "right") - 1
        fits = (y >= 0) & (x >= 0) & (y < ny[mine]) & (x < nx[mine])
        v[(np.append(0, ends[:-1])[mine] + y * nx[mine] + x)[fits]] = b.column(5 + r).take(pa.array(rows[fits])).to_numpy()
        for i in range(0, len(of), 20_000):
            part = slice(i, i + 20_000)
            take = pa.array(head[of[part]])
            at = [pa.array((within[part] // nx[of[part]]).astype(np.int32)), pa.array((within[part] % nx[of[part]]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *at, *[b.column(3 + j).take(take) for j in range(r)], pa.array(v[part])], names)

    def run(batches):
        for b in whole_groups(batches, 2):
            first = np.flatnonzero(~same_as_before(b.columns[:2]))
            live = np.repeat(b.column(2).to_numpy()[first] == 0, np.diff(np.append(first, b.num_rows)))
            if not live.all():  # outside the shapes there is no slice
                b = b.filter(pa.array(live))
                if not b.num_rows:
                    continue
                first = np.flatnonzero(~same_as_before(b.columns[:2]))
            last = np.append(first[1:], b.num_rows)
            areas = [b.column(3 + rest.index(c)).take(pa.array(first)).to_numpy().astype(np.int64) for c in ("ny", "nx")]
            chunk = np.cumsum(areas[0] * areas[1]) // (1 << 18)
            for c in np.unique(chunk):
                mine = chunk == c
                yield from some(b, first[mine], int(first[mine][0]), int(last[mine][-1]))

    placed = heads.unionByName(present).repartition(by, "z").sortWithinPartitions(by, "z", "__kind")
    kinds = {by: shapes.schema[by].dataType.simpleString(), "z": "int", "y": "int", "x": "int", **{c: shapes.schema[c].dataType.simpleString() for c in rest}, value: "double"}
    return placed.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def resample(
    targets: DataFrame,
    voxels: DataFrame,
    keys: Sequence[str],
    source: Sequence[Column],
    shape: Sequence[Column],
    order: int = 1,
    value: str = "v",
    by: str = "pid",
) -> DataFrame:
    """Value of each target row at its source position in the patient's volume.

    Order 0 takes the nearest voxel, order 1 interpolates between the eight around. Positions outside
    [0, n - 1] on any axis give 0, absent voxels count as 0. ``targets`` holds ``by`` and ``keys``
    (unique together), ``source`` and ``shape`` are columns of it. For positions of any kind: the corners of a
    target become rows. Grids read through affine maps take :func:`~voxelframe.plans.bricks.resample_affine`, as the
    functions below do. Only corners with a positive weight travel to the join with the voxels, so aligned axes do not multiply
    the rows; a target outside travels once, without a position.
    """
    t = targets.select(
        by, *keys, *[s.cast("double").alias(f"__s{c}") for s, c in zip(source, AXES)],
        *[(n - 1).alias(f"__n{c}") for n, c in zip(shape, AXES)],
    )
    inside = F.lit(True)
    for c in AXES:
        inside = inside & (F.col(f"__s{c}") >= 0) & (F.col(f"__s{c}") <= F.col(f"__n{c}"))
    none = F.struct(F.lit(None).cast("int").alias("k"), F.lit(0.0).alias("w"))
    corners, weight = t.withColumn("__in", F.coalesce(inside, F.lit(False))), F.lit(1.0)
    for c in AXES:
        s = F.col(f"__s{c}")
        if order == 0:
            corners = corners.withColumn(f"__k{c}", F.when(F.col("__in"), F.floor(s + 0.5).cast("int")))
        else:
            low = F.floor(s)
            part = s - low
            ends = F.array(
                F.struct(low.cast("int").alias("k"), (1 - part).alias("w")),
                F.struct((low + 1).cast("int").alias("k"), part.alias("w")),
            )
            ends = F.when(F.col("__in"), F.filter(ends, lambda e: e["w"] > 0)).otherwise(F.array(none))
            corners = corners.withColumn(f"__e{c}", F.explode(ends))
            corners = corners.withColumn(f"__k{c}", F.col(f"__e{c}.k")).withColumn(f"__w{c}", F.col(f"__e{c}.w"))
            weight = weight * F.col(f"__w{c}")
    corners = corners.select(by, *keys, *[f"__k{c}" for c in AXES], weight.alias("__w"))
    v = voxels.select(
        by, *[F.col(c).alias(f"__k{c}") for c in AXES], F.col(value).cast("double").alias("__v")
    )
    met = corners.join(v, [by, *[f"__k{c}" for c in AXES]], "left")
    return met.groupBy(by, *keys).agg(F.sum(F.coalesce(F.col("__w") * F.col("__v"), F.lit(0.0))).alias(value))


def transform_scan(
    voxels: DataFrame, shapes: DataFrame, spacing: Sequence[Column | float], patch: Sequence[int],
    patch_mm: Sequence[float], value: str = "v", by: str = "pid", order: int = 1, **augment,
) -> DataFrame:
    """Scan resampled to the patch grid around its middle. ``spacing`` are columns of ``shapes``."""
    n = [F.col(f"n{c}") for c in AXES]
    m = A.scan_map(n, spacing, patch, patch_mm, **augment)
    maps = shapes.select(by, *[f"n{c}" for c in AXES], *A.to_columns(m))
    return resample_affine(brick_pieces(voxels, value, by), maps, [], patch, AXES, order, value, by, routes=None)


def transform_mask(mask: DataFrame, shapes: DataFrame, *args, by: str = "pid", **kw) -> DataFrame:
    """Sparse mask resampled like the scan; any positive share sets the voxel."""
    ones = mask.select(by, *AXES, F.lit(1.0).alias("v"))
    return transform_scan(ones, shapes, *args, value="v", by=by, **kw).filter("v > 0").select(by, *AXES)


def transform_points(
    points: DataFrame, m: A.Matrix, patch: Sequence[int], patch_mm: Sequence[float], diameter: str = "d",
    out_spacing: Sequence[float] = (1.0, 1.0, 1.0),
) -> DataFrame:
    """Scan voxels to patch voxels (the inverse map), rounded half to even, diameter rescaled."""
    moved = A.apply(A.inverse(m), [F.col(c) for c in AXES])
    new = {f"o{c}": A.rint(p) for c, p in zip(AXES, moved)}
    new["od"] = A.rint(A.scaled_diameter(F.col(diameter), patch, patch_mm, out_spacing))
    return points.withColumns(new)


def _patch_maps(
    candidates: DataFrame, shapes: DataFrame, spacing: Sequence[Column | float], patch: Sequence[int], patch_mm: Sequence[float], cid: str,
    by: str, **augment,
) -> DataFrame:
    c = candidates.join(shapes, by)
    m = A.patch_map([F.col(a) for a in AXES], spacing, patch, patch_mm, **augment)
    return c.select(by, cid, *[f"n{a}" for a in AXES], *A.to_columns(m))


def extract_patches(
    candidates: DataFrame, voxels: DataFrame, shapes: DataFrame, spacing: Sequence[Column | float],
    patch: Sequence[int], patch_mm: Sequence[float], cid: str = "cid", value: str = "v", by: str = "pid",
    order: int = 1, **augment,
) -> DataFrame:
    """One resampled patch per candidate: (pid, cid, pz, py, px, value).

    A candidate with a NULL position is an empty slot and yields zeros.
    """
    maps = _patch_maps(candidates, shapes, spacing, patch, patch_mm, cid, by, **augment)
    return resample_affine(brick_pieces(voxels, value, by), maps, [cid], patch, ("pz", "py", "px"), order, value, by)


def patch_pieces(
    candidates: DataFrame, voxels: DataFrame, shapes: DataFrame, spacing: Sequence[Column | float],
    patch: Sequence[int], patch_mm: Sequence[float], cid: str = "cid", value: str = "v", by: str = "pid",
    order: int = 1, change: Callable[[np.ndarray], np.ndarray] | None = None, **augment,
) -> DataFrame:
    """The patches of :func:`extract_patches` as arrays: (pid, cid, places, value), places in raster order or empty for a whole patch.

    A patch that lies in one brick and one block is one piece. No voxel of a patch is ever a row. ``change`` takes the values, a flat array of
    many patches, before they become rows.
    """
    maps = _patch_maps(candidates, shapes, spacing, patch, patch_mm, cid, by, **augment)
    return resample_affine(brick_pieces(voxels, value, by), maps, [cid], patch, ("pz", "py", "px"), order, value, by, packed=True, change=change)


def whole_patches(
    candidates: DataFrame, voxels: DataFrame, shapes: DataFrame, spacing: Sequence[Column | float],
    patch: Sequence[int], patch_mm: Sequence[float], cid: str = "cid", value: str = "v", by: str = "pid",
    order: int = 1, change: Callable[[np.ndarray], np.ndarray] | None = None, **augment,
) -> DataFrame:
    """(pid, cid, value): the same patches, one array each in raster order. Only patches that several bricks or blocks share are shuffled as arrays."""
    maps = _patch_maps(candidates, shapes, spacing, patch, patch_mm, cid, by, **augment)
    bricks = brick_pieces(voxels, value, by)
    placed = dealt(bricks, maps, [cid], patch, by)
    whole, parts = (
        resample_affine(bricks, maps, [cid], patch, ("pz", "py", "px"), order, value, by, packed=kind, change=change, placed=placed) for kind in ("whole", "parts")
    )
    return whole.select(by, cid, value).unionByName(whole_grids(parts, [cid], value, by))


def crop_pieces(
    candidates: DataFrame, voxels: DataFrame, shapes: DataFrame, half: int, cid: str = "cid", value: str = "v", by: str = "pid",
) -> DataFrame:
    """(pid, cid, places, value): voxels in [c - half, c + half) around each rounded candidate in pieces, zeros where there is none.

    Nothing is interpolated. A candidate with a NULL position, or whose scan has no voxels, yields zeros. Voxel positions begin at 0.
    """
    m = A.identity()
    for i, c in enumerate(AXES):
        m[i][3] = F.bround(F.col(c)) - half
    sized = candidates.select(by, cid, *AXES).join(shapes.select(by, *[f"n{c}" for c in AXES]), by, "left")
    maps = sized.select(by, cid, *[F.coalesce(f"n{c}", F.lit(1)).alias(f"n{c}") for c in AXES], *A.to_columns(m))
    return resample_affine(brick_pieces(voxels, value, by), maps, [cid], [2 * half] * 3, ("pz", "py", "px"), 0, value, by, packed=True)


# --- shapes ----------------------------------------------------------------------------------


def rasterise(
    points: DataFrame, shape: Sequence[int | Column], kind: str = "sphere", diameter: str = "d", keep: Sequence[str] = (),
    by: str = "pid",
) -> DataFrame:
    """Set voxels of a shape around each point, clipped to the grid.

    ``sphere`` and ``cube`` have value 1; ``gauss`` is exp(-d^2 / 2r^2), cut where d^2 > 3r^2. Centre
    and radius are rounded half to even. A gaussian of radius 0 is its centre voxel.
    """
    reach = F.col("__r") if kind != "gauss" else F.ceil(F.col("__r") * F.lit(3.0**0.5))
    p = points.select(
        by, *keep, *[A.rint(F.col(c)).alias(f"__c{c}") for c in AXES], A.rint(F.col(diameter) / 2).alias("__r")
    )
    d2 = F.lit(0.0)
    for c, n in zip(AXES, shape):
        last = (n if isinstance(n, Column) else F.lit(n)) - 1
        low = F.greatest(F.col(f"__c{c}") - reach, F.lit(0.0)).cast("int")
        high = F.least(F.col(f"__c{c}") + reach, last).cast("int")
        p = p.withColumn("__lo", low).withColumn("__hi", high).filter("__lo <= __hi").withColumn(
            c, F.explode(F.sequence("__lo", "__hi"))
        )
        d2 = d2 + (F.col(c) - F.col(f"__c{c}")) * (F.col(c) - F.col(f"__c{c}"))
    r2 = F.col("__r") * F.col("__r")
    v = F.lit(1.0)
    if kind == "sphere":
        p = p.filter(d2 <= r2)
    elif kind == "gauss":
        p = p.filter(d2 <= 3 * r2)
        v = F.when(r2 > 0, F.exp(-d2 / (2 * r2))).otherwise(F.lit(1.0))
    elif kind != "cube":
        raise ValueError("kind is sphere, cube or gauss")
    return p.select(by, *keep, *AXES, v.alias("v"))


def union_masks(parts: DataFrame, by: str = "pid", value: str = "v") -> DataFrame:
    """Sum of masks clipped to 1, one row per set voxel."""
    return parts.groupBy(by, *AXES).agg(F.least(F.sum(value), F.lit(1.0)).alias(value))


def rasterise_union(
    points: DataFrame, shape: Sequence[int | Column], kind: str = "sphere", diameter: str = "d", by: str = "pid",
) -> DataFrame:
    """(by, z, y, x, v): the :func:`union_masks` of the shapes of :func:`rasterise`, without a row per point and voxel.

    A point travels to the bricks its shape touches and is drawn there; a voxel becomes a row once, when all points of its brick are drawn.
    """
    if kind not in ("sphere", "cube", "gauss"):
        raise ValueError("kind is sphere, cube or gauss")
    sizes = [(n if isinstance(n, Column) else F.lit(n)).cast("int") for n in shape]
    p = points.select(by, *[A.rint(F.col(c)).alias(f"__c{c}") for c in AXES], A.rint(F.col(diameter) / 2).alias("__cr"), *[n.alias(f"__cn{c}") for n, c in zip(sizes, AXES)])
    p = p.filter(" and ".join(f"__c{c} is not null" for c in "zyxr"))
    reach = F.col("__cr") if kind != "gauss" else F.ceil(F.col("__cr") * F.lit(3.0**0.5))
    low = [F.greatest(F.col(f"__c{c}") - reach, F.lit(0.0)) for c in AXES]
    high = [F.least(F.col(f"__c{c}") + reach, F.col(f"__cn{c}") - 1) for c in AXES]

    def run(batches):
        for b in whole_groups(batches, 2):
            starts = np.flatnonzero(~same_as_before(b.columns[:2]))
            code = b.column(1).to_numpy()
            balls = np.stack([b.column(2 + i).to_numpy() for i in range(4)], axis=1)
            n = np.stack([b.column(6 + i).to_numpy() for i in range(3)], axis=1)
            found, values = [], []
            for lo, hi in zip(starts, np.append(starts[1:], b.num_rows)):
                first = origin(int(code[lo]))
                data = _drawn(balls[lo:hi], kind, first, np.minimum(n[lo] - first, EDGE))
                at = np.argwhere(data)
                found.append(at + first)
                values.append(data[tuple(at.T)])
            rows = pa.array(np.repeat(starts, [len(f) for f in found]))
            places = np.concatenate(found).astype(np.int32)
            v = np.minimum(np.concatenate(values), 1.0)
            out = pa.RecordBatch.from_arrays([b.column(0).take(rows), *[pa.array(np.ascontiguousarray(c)) for c in places.T], pa.array(v)], [by, *AXES, "v"])
            yield from (out.slice(i, 50_000) for i in range(0, out.num_rows, 50_000))

    carried = [F.col(f"__c{c}") for c in "zyxr"] + [F.col(f"__cn{c}") for c in AXES]
    kind_of = points.schema[by].dataType.simpleString()
    return to_bricks(p, [by], low, high, carried).mapInArrow(run, f"`{by}` {kind_of}, z int, y int, x int, v double")


def _drawn(balls: np.ndarray, kind: str, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of the shapes (rows z, y, x, radius) over the voxels ``first`` to ``first + size``."""
    out = np.zeros(size)
    balls, counts = np.unique(balls, axis=0, return_counts=True)
    for r in np.unique(balls[:, 3]):
        mine = balls[:, 3] == r
        reach = int(r if kind != "gauss" else np.ceil(r * 3.0**0.5))
        step = np.arange(-reach, reach + 1)
        d2 = step[:, None, None] ** 2 + step[None, :, None] ** 2 + step[None, None, :] ** 2
        if kind == "gauss":
            shape = np.where(d2 <= 3 * r * r, np.exp(-d2 / (2 * r * r)) if r > 0 else 1.0, 0.0)
        else:
            shape = np.ones(d2.shape) if kind == "cube" else (d2 <= r * r).astype(float)
        at, times = (balls[mine, :3] - first).astype(np.int64), counts[mine]
        if len(at) < (shape > 0).sum():  # the shape at each point
            for c, t in zip(at, times):
                lo, hi = np.maximum(c - reach, 0), np.minimum(c + reach + 1, size)
                part = tuple(slice(a, b) for a, b in zip(lo - c + reach, hi - c + reach))
                out[tuple(slice(a, b) for a, b in zip(lo, hi))] += t * shape[part]
        else:  # the points at each place of the shape
            around = np.zeros(size + 2 * reach)
            around[tuple((at + reach).T)] = times
            for o in np.argwhere(shape > 0):
                back = 2 * reach - o
                out += shape[tuple(o)] * around[tuple(slice(a, a + n) for a, n in zip(back, size))]
    return out


def gaussian_axes(centre: Sequence[Column], diameter: Column, n: int) -> list[Column]:
    """Per axis the vector exp(-(c - i)^2 / 2r^2), i = 0..n-1; radius 0 marks the centre only."""
    r2 = (diameter / 2) * (diameter / 2)

    def axis(c: Column) -> Column:
        def value(i: Column) -> Column:
            at_centre = F.when(c == i, F.lit(1.0)).otherwise(F.lit(0.0))
            return F.coalesce(F.exp(-F.try_divide((c - i) * (c - i), 2 * r2)), at_centre)

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)

    return [axis(c).alias(f"label_{a}") for c, a in zip(centre, AXES)]


# --- tiles -----------------------------------------------------------------------------------


def n_windows(size: int, window: int, stride: int) -> int:
    return (size - window) // stride + 1


def tile(
    voxels: DataFrame, shape: Sequence[int], window: int, stride: int, counts: Sequence[int] | None = None
) -> DataFrame:
    """One row per (voxel, tile that contains it), with tile ids and local coordinates.

    Tiles overlap when the stride is smaller than the window; the tile ids follow from arithmetic, so
    nothing is joined.
    """
    counts = [n_windows(n, window, stride) for n in shape] if counts is None else counts
    out = voxels
    for c, n in zip(AXES, counts):
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - (window - 1)) / stride)).cast("int")
        last = F.least(F.lit(n - 1), F.floor(F.col(c) / stride)).cast("int")
        out = out.withColumn("__a", first).withColumn("__b", last).filter("__a <= __b").withColumn(
            f"t{c}", F.explode(F.sequence("__a", "__b"))
        ).withColumn(f"l{c}", F.col(c) - F.col(f"t{c}") * stride)
    return out.drop("__a", "__b")


def stitch(tiles: DataFrame, shape: Sequence[int], window: int, stride: int, value: str = "v", by: str = "pid") -> DataFrame:
    """Tile results put back: the first ``stride`` positions of a tile are its own, and the stitched
    block is centred in the scan. Positions no tile covers have no row (they are 0)."""
    own = F.lit(True)
    cols = []
    for c, n in zip(AXES, shape):
        pad = (n - n_windows(n, window, stride) * stride) // 2
        own = own & (F.col(f"l{c}") < stride)
        cols.append((F.col(f"t{c}") * stride + F.col(f"l{c}") + pad).cast("int").alias(c))
    return tiles.filter(own).select(by, *cols, value)


def sliding_counts(shape: Sequence[int], patch: int, stride: int) -> list[int]:
    """Number of starts 0, stride, ... strictly below size - patch."""
    return [max(0, -(-(n - patch) // stride)) for n in shape]


def sliding_features(
    voxels: DataFrame, shape: Sequence[int], patch: int, stride: int, features: Sequence[Column], by: str = "pid"
) -> DataFrame:
    """Aggregates of every sliding patch: (pid, tz, ty, tx, features...)."""
    tiles = tile(voxels, shape, patch, stride, sliding_counts(shape, patch, stride))
    return tiles.groupBy(by, "tz", "ty", "tx").agg(*features)


def zoom(
    voxels: DataFrame, shapes: DataFrame, spacing: Sequence[float], new_spacing: Sequence[float], value: str = "v",
    by: str = "pid", order: int = 1,
) -> DataFrame:
    """Scan resampled to a spacing: output sizes round(n * factor), end voxels stay end voxels.

    The result carries the spacing that the rounded size really has (``sz, sy, sx``).
    """
    s = shapes
    for c, old, new in zip(AXES, spacing, new_spacing):
        s = s.withColumn(f"m{c}", F.greatest(F.bround(F.col(f"n{c}") * F.lit(old / new)), F.lit(1.0)).cast("int"))
        s = s.withColumn(f"s{c}", F.lit(float(old)) * F.col(f"n{c}") / F.col(f"m{c}"))
    steps = [F.coalesce(F.try_divide(F.col(f"n{c}") - F.lit(1.0), F.col(f"m{c}") - F.lit(1.0)), F.lit(0.0)) for c in AXES]
    m: A.Matrix = A.identity()
    for i, step in enumerate(steps):
        m[i][i] = step
    maps = s.select(by, *[f"n{c}" for c in AXES], *[f"m{c}" for c in AXES], *A.to_columns(m))
    # the last voxel may land a rounding error beyond the end
    out = resample_affine(
        brick_pieces(voxels, value, by), maps, [], [F.col(f"m{c}") for c in AXES], AXES, order, value, by, snap=True, routes=None
    )
    return out.join(s.select(by, "sz", "sy", "sx"), by)
