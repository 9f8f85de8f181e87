"""Connected components, region properties, holes, borders, hulls and slice-overlap pruning.

A label is the raster-first voxel of its component, packed into a long, so labels sort in raster order
and need no numbering. Slices and bricks are the largest pieces any task holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe.operators.morphology import AXES, neighbour_offsets
from voxelframe.plans.bricks import same_as_before, whole_groups
from voxelframe.plans.graph import connected_components
from voxelframe.plans.pieces import map_pieces, piece_index, split_pieces
from voxelframe.session import cut

BITS = 20  # coordinates are below 2^20 - 1


def packed(z: Column, y: Column, x: Column) -> Column:
    fits = (F.least(z, y, x) >= 0) & (F.greatest(z, y, x) < 2**BITS)
    code = F.shiftleft(z.cast("long"), 2 * BITS) + F.shiftleft(y.cast("long"), BITS) + x.cast("long")
    return F.when(fits, code).otherwise(F.raise_error(F.lit("a coordinate has more than 20 bits")).cast("long"))


def _forward(offsets: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return [o for o in offsets if o > (0, 0, 0)]


def _roots(keys: np.ndarray, steps: Sequence[int]) -> np.ndarray:
    """Position of the smallest key linked to each of the sorted keys by the given steps."""
    n = len(keys)
    left, right = [], []
    for s in steps:
        at = np.searchsorted(keys, keys + s)
        hit = (at < n) & (keys[np.minimum(at, n - 1)] == keys + s)
        left.append(np.flatnonzero(hit))
        right.append(at[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low != high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump


def _local_labels(mask: DataFrame, by: Sequence[str], piece: Sequence[Column], offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Components inside pieces, all pieces of a batch in one go."""
    pieces = [f"__p{i}" for i in range(len(piece))]
    rows = mask.select(
        *by, *[p.alias(n) for p, n in zip(piece, pieces)], *[F.col(c).cast("int").alias(c) for c in AXES],
        packed(*[F.col(c) for c in AXES]).alias("__k"),
    )
    keys = [*by, *pieces]
    forward = _forward(offsets)
    schema = T.StructType([
        *[mask.schema[b] for b in by], *[T.StructField(c, T.IntegerType()) for c in AXES], T.StructField("label", T.LongType())
    ])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # positions on one padded line: a step never runs into another row, slice or piece
        line = piece_index(pdf, keys).astype(np.int64)
        strides = []
        for c in AXES:
            at = pdf[c].to_numpy().astype(np.int64)
            size = int(at.max() - at.min()) + 2
            line = line * size + (at - at.min())
            strides = [s * size for s in strides] + [1]
        steps = [int(np.dot(o, strides)) for o in forward]
        pdf["label"] = pdf["__k"].to_numpy()[_roots(line, steps)]
        return pdf[[*by, *AXES, "label"]]

    return map_pieces(rows, keys, ["__k"], run, schema)


def label_slices(mask: DataFrame, by: Sequence[str] = ("pid",), diagonal: bool = True, slab: int = 8) -> DataFrame:
    """2-D components of every slice; a task sees ``slab`` slices at a time."""
    offsets = [o for o in neighbour_offsets(2 if diagonal else 1) if o[0] == 0]
    return _local_labels(mask, list(by), [F.floor(F.col("z") / slab).cast("int")], offsets)


def label_volume(mask: DataFrame, by: Sequence[str] = ("pid",), connectivity: int = 3, brick: int = 64) -> DataFrame:
    """3-D components: labels inside bricks, then a graph of the labels that touch across bricks.

    Only voxels on brick faces take part in the second step, and the graph has one node per local
    component, not per voxel.
    """
    by = list(by)
    offsets = neighbour_offsets(connectivity)
    piece = [F.floor(F.col(c) / brick).cast("int") for c in AXES]
    # written once: the labels are read again for the edges and for the result
    local = cut(_local_labels(mask, by, piece, offsets))
    on_face = F.lit(False)
    for c in AXES:
        on_face = on_face | (F.col(c) % brick == 0) | (F.col(c) % brick == brick - 1)
    face = local.filter(on_face)
    o = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(off, AXES)]) for off in _forward(offsets)])
    moved = face.select(*by, F.col("label").alias("__l"), *[F.col(c).alias(f"__f{c}") for c in AXES], F.explode(o).alias("__o"))
    moved = moved.select(*by, "__l", *[f"__f{c}" for c in AXES], *[(F.col(f"__f{c}") + F.col(f"__o.{c}")).alias(c) for c in AXES])
    crosses = F.lit(False)
    for c in AXES:
        crosses = crosses | (F.floor(F.col(c) / brick) != F.floor(F.col(f"__f{c}") / brick))
    touching = moved.filter(crosses).join(face, [*by, *AXES])
    edges = touching.select(F.struct(*by, F.col("__l").alias("label")).alias("src"), F.struct(*by, "label").alias("dst")).distinct()
    comps = connected_components(edges).select("node", F.col("component.label").alias("__root"))
    return (
        local.withColumn("node", F.struct(*by, "label")).join(comps, "node", "left")
        .withColumn("label", F.coalesce("__root", "label")).drop("node", "__root")
    )


def region_properties(labelled: DataFrame, by: Sequence[str] = ("pid",)) -> DataFrame:
    """Area, centroid and bounding box of every label."""
    return labelled.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("area"), *[F.avg(c).alias(f"c{c}") for c in AXES],
        *[f(c).alias(f"{n}{c}") for c in AXES for n, f in (("min_", F.min), ("max_", F.max))],
    )


def largest_label(labelled: DataFrame, by: Sequence[str] = ("pid",)) -> DataFrame:
    """The label of the largest region; of equal ones the raster-first."""
    sizes = labelled.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("area"))
    return sizes.groupBy(*by).agg(F.max_by("label", F.struct("area", -F.col("label"))).alias("label"))


def keep_largest(labelled: DataFrame, by: Sequence[str] = ("pid",)) -> DataFrame:
    return labelled.join(largest_label(labelled, by), [*by, "label"], "left_semi")


def _reaches_edge(by: Sequence[str], ny: int | Column, nx: int | Column) -> Column:
    """Does the row's slice component touch the edge of its slice?

    A window over one component of one slice, so the labels are computed once and a partition never
    holds more than a slice.
    """
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == ny - 1) | (F.col("x") == nx - 1)
    return F.max(edge).over(Window.partitionBy(*by, "label"))


def clear_border(mask: DataFrame, ny: int | Column, nx: int | Column, by: Sequence[str] = ("pid",)) -> DataFrame:
    """Drop slice components that touch the edge of their slice."""
    labelled = label_slices(mask, by).withColumn("__edge", _reaches_edge(by, ny, nx))
    return labelled.filter("not __edge").select(*by, *AXES)


def mark_filled(
    dense: DataFrame, inside: Column, ny: int | Column, nx: int | Column, by: Sequence[str] = ("pid",), name: str = "__in", placed: bool = False
) -> DataFrame:
    """The table with ``name``: 1 for set positions and for background the slice edge cannot reach (by steps along the axes), else 0.

    Slices are worked on as whole arrays, many small ones in one go; ``placed`` says that the table comes from ``morphology.by_slice`` or
    ``volume.densify``, and the result is placed as well.
    """
    by = list(by)
    m = len(by) + 1
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == ny - 1) | (F.col("x") == nx - 1)
    rest = [c for c in dense.columns if c not in (*by, "z")]
    rows = dense if placed else dense.repartition(*by, "z").sortWithinPartitions(*by, "z")
    rows = rows.select(*by, "z", *rest, F.coalesce(inside, F.lit(False)).alias("__inside"), edge.alias("__edge"))
    aty, atx = (m + rest.index(c) for c in ("y", "x"))

    def run(batches):
        for b in whole_groups(batches, m):
            line = np.cumsum(~same_as_before(b.columns[:m])).astype(np.int64)
            width = 0
            for i in (aty, atx):
                at = b.column(i).to_numpy().astype(np.int64)
                width = int(at.max() - at.min()) + 2
                line = line * width + (at - at.min())
            set_, border = (b.column(b.num_columns - i).to_numpy(zero_copy_only=False) for i in (2, 1))
            back = np.flatnonzero(~set_)
            back = back[np.argsort(line[back], kind="stable")]
            flag = set_.astype(np.int32)
            if len(back):
                root = _roots(line[back], [1, width])
                open_ = np.zeros(len(back), bool)
                open_[root[border[back]]] = True
                flag[back] = ~open_[root]
            out = pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(flag)], [*b.schema.names[:-2], name])
            yield from (out.slice(i, 20_000) for i in range(0, out.num_rows, 20_000))

    schema = T.StructType([*rows.schema.fields[:-2], T.StructField(name, T.IntegerType())])
    return rows.mapInArrow(run, schema).select(*dense.columns, name)


def fill_holes(dense: DataFrame, inside: Column, ny: int | Column, nx: int | Column, by: Sequence[str] = ("pid",), placed: bool = False) -> DataFrame:
    """Set voxels plus the background the slice edge cannot reach (by steps along the axes).

    ``dense`` has every grid position, ``inside`` tells whether it is set; ``placed``: see :func:`mark_filled`.
    """
    return mark_filled(dense, inside, ny, nx, by, "__in", placed).filter("__in = 1").select(*by, *AXES)


# --- convex hulls ----------------------------------------------------------------------------


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _hull_side(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    side: list[tuple[float, float]] = []
    for p in points:
        while len(side) >= 2 and _cross(side[-2], side[-1], p) <= 0:
            side.pop()
        side.append(p)
    return side


def _hull_rows(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last column of the hull in every row, from the row extents of a shape.

    Pixels count as diamonds: the hull spans the middles of their four edges. A pixel belongs to the
    hull when its centre is inside or on the border.
    """
    rim = [(r + dr, c) for r, a, b in zip(rows, low, high) for dr in (-0.5, 0.5) for c in (a, b)]
    rim += [(float(r), a - 0.5) for r, a in zip(rows, low)] + [(float(r), b + 0.5) for r, b in zip(rows, high)]
    rim.sort()
    under, over = np.array(_hull_side(rim)), np.array(_hull_side(rim[::-1])[::-1])
    every = np.arange(rows.min(), rows.max() + 1)
    # vertical end edges give two columns at one row half; the rows asked for lie strictly between
    lo = np.interp(every, under[:, 0], under[:, 1])
    hi = np.interp(every, over[:, 0], over[:, 1])
    return every, np.ceil(lo - 1e-9).astype(int), np.floor(hi + 1e-9).astype(int)


def convex_hull(mask: DataFrame, axis: str = "z", by: Sequence[str] = ("pid",)) -> DataFrame:
    """Hull of every slice across an axis.

    The hull depends only on the first and last set pixel of each row, so the mask is aggregated to row
    extents, the hull is found on those, and its rows are filled by ``sequence`` again.
    """
    by = list(by)
    row, col = [c for c in AXES if c != axis]
    extents = mask.groupBy(*by, axis, row).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    fields = [mask.schema[b] for b in by] + [T.StructField(n, T.IntegerType()) for n in (axis, row, "__lo", "__hi")]

    keys = [*by, axis]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for g in split_pieces(pdf, keys):
            r, lo, hi = _hull_rows(g[row].to_numpy(), g["__lo"].to_numpy(), g["__hi"].to_numpy())
            parts.append(pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, row: r, "__lo": lo, "__hi": hi}))
        return pd.concat(parts, ignore_index=True)[[*keys, row, "__lo", "__hi"]]

    hull = map_pieces(extents, keys, [row], run, T.StructType(fields))
    return hull.select(*by, axis, row, F.explode(F.sequence("__lo", "__hi")).alias(col)).select(*by, *AXES)


# --- overlap between neighbouring slices -----------------------------------------------------


def prune_by_overlap(
    mask: DataFrame, middle: int | Column, min_pixels: int = 7, min_share: float = 0.015, by: str = "pid",
) -> DataFrame:
    """Drop slice regions with too little overlap with what is left of the next slice towards the middle.

    A region's fate hangs on the regions one slice further in, so removal cascades outward. All regions
    start alive and the ones with too little overlap with living regions go, round by round, until
    nothing changes; since overlap can only shrink this ends in the same set as walking the slices one
    by one, in as many rounds as the longest cascade. The rounds work on region pairs, not voxels.
    ``middle`` is the slice every walk starts from, a column of ``mask`` or a number.
    """
    mid = middle if isinstance(middle, Column) else F.lit(middle)
    with_mid = mask.select(by, *AXES, mid.cast("int").alias("__mid"))
    # written once: the labels feed the regions, the overlaps and the result
    labelled = cut(label_slices(with_mid, [by, "__mid"]))
    towards = F.when(F.col("z") > F.col("__mid"), F.col("z") - 1).when(F.col("z") < F.col("__mid"), F.col("z") + 1)
    child = labelled.withColumn("__inner", towards)
    regions = cut(child.groupBy(by, "label").agg(F.count(F.lit(1)).alias("area"), F.max("__inner").alias("__inner")))
    inner = labelled.select(by, F.col("z").alias("__inner"), "y", "x", F.col("label").alias("parent"))
    overlaps = cut(
        child.join(inner, [by, "__inner", "y", "x"]).groupBy(by, "label", "parent").agg(F.count(F.lit(1)).alias("n"))
    )
    alive, n_alive = regions.select(by, "label"), regions.count()
    while True:  # a round drops a region or is the last
        living = alive.select(by, F.col("label").alias("parent"))
        total = overlaps.join(living, [by, "parent"], "left_semi").groupBy(by, "label").agg(F.sum("n").alias("total"))
        held = regions.join(total, [by, "label"], "left").filter(
            F.col("__inner").isNull() | ((F.col("total") >= min_pixels) & (F.col("total") / F.col("area") >= min_share))
        )
        alive = cut(held.select(by, "label"))
        now = alive.count()
        if now == n_alive:
            return labelled.join(alive, [by, "label"], "left_semi").select(by, *AXES)
        n_alive = now
