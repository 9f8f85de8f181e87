"""Binary and grey morphology on voxel tables.

Disks act per slice on *dense* tables (every grid position has a row). The rows are placed by slice once, which serves
all filters of a chain; a task holds one slice, or some small ones, at a time as an array, and even one enormous scan spreads over as many
tasks as it has slices. A disk is a stack of horizontal runs: the extreme over a run of any width takes a
logarithmic number of steps over the slice, and runs of one width are shared by all rows of the disk, so a radius of 13 costs little
more than one of 2. Positions without a row, and null values, are ignored.

Small 3-D structures act on *sparse* masks (only set voxels have rows), on bricks with as much of their surroundings as the
structures reach; a voxel travels to the few bricks it can reach and not once per offset.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.plans.bricks import EDGE, origin, same_as_before, to_bricks, whole_groups

AXES = ("z", "y", "x")
#: Small slices are filtered side by side, up to this many places.
CELLS = 1 << 18


def run_widths(radius: int) -> dict[int, int]:
    """Half width of the disk's run at each vertical offset."""
    return {dy: math.isqrt(radius * radius - dy * dy) for dy in range(-radius, radius + 1)}


def by_slice(dense: DataFrame, by: str = "pid") -> DataFrame:
    """The table placed and sorted by slices: what all disk filters after it need, so they shuffle and sort no more."""
    return dense.repartition(by, "z").sortWithinPartitions(by, "z")


def _runs(a: np.ndarray, w: int, pick: np.ufunc, none: float) -> np.ndarray:
    """The extreme over x - w to x + w of each place of a slice, or of many (the last axis is x)."""
    n, length = a.shape[-1], 2 * w + 1
    m = np.full((*a.shape[:-1], n + 2 * w), none)
    m[..., w : w + n] = a
    span = 1
    while 2 * span <= length:
        m = pick(m[..., :-span], m[..., span:])
        span *= 2
    return pick(m[..., :n], m[..., length - span : length - span + n])


def slice_extreme(a: np.ndarray, radius: int, largest: bool) -> np.ndarray:
    """The extreme over a disk around each place of a slice, or of many (the last axes are y, x); places without a value hold the infinity that never wins."""
    pick, none = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
    out = np.full(a.shape, none)
    rows = a.shape[-2]
    by_width: dict[int, list[int]] = {}
    for dy, w in run_widths(radius).items():
        by_width.setdefault(w, []).append(dy)
    for w, shifts in by_width.items():
        run = _runs(a, w, pick, none)
        for dy in shifts:
            lo, hi = max(0, -dy), min(rows, rows - dy)
            if lo < hi:
                out[..., lo:hi, :] = pick(out[..., lo:hi, :], run[..., lo + dy : hi + dy, :])
    return out


def disk_chain(
    dense: DataFrame, value: str, steps: Sequence[tuple[int, bool]], by: str = "pid", placed: bool = False
) -> DataFrame:
    """The value replaced, step by step, by its maximum or minimum over a disk in the slice.

    ``steps``: radius, and whether the maximum is taken. ``placed`` says that the table comes from :func:`by_slice` or from a
    disk filter, or is a filter or column of such a one; other columns stay as they are.
    """
    steps = [(r, largest) for r, largest in steps if r > 0]
    if not steps:
        return dense
    names = [by, "z", *[c for c in dense.columns if c not in (by, "z")]]
    at = {c: names.index(c) for c in ("y", "x", value)}

    def filtered(t: pa.RecordBatch) -> pa.RecordBatch:
        first = np.flatnonzero(~same_as_before(t.columns[:2]))
        size = np.diff(np.append(first, t.num_rows))
        y, x = (t.column(at[c]).to_numpy().astype(np.int64) for c in ("y", "x"))
        y, x = (c - np.repeat(np.minimum.reduceat(c, first), size) for c in (y, x))
        v = t.column(at[value])
        a = v.cast(pa.float64()).to_numpy(zero_copy_only=False).copy()
        a[pc.is_null(v).to_numpy(zero_copy_only=False)] = np.nan
        h, w = int(y.max()) + 1, int(x.max()) + 1
        most = max(1, CELLS // (h * w))  # slices side by side
        for i in range(0, len(first), most):
            part = slice(first[i], first[i] + size[i : i + most].sum())
            n = len(size[i : i + most])
            place = (np.repeat(np.arange(n), size[i : i + most]), y[part], x[part])
            grid, empty = np.full((n, h, w), np.nan), np.ones((n, h, w), bool)
            grid[place], empty[place] = a[part], False
            for r, largest in steps:
                none = -np.inf if largest else np.inf
                got = slice_extreme(np.where(np.isnan(grid), none, grid), r, largest)
                grid = np.where((got == none) | empty, np.nan, got)
            a[part] = grid[place]
        return t.set_column(at[value], t.schema.field(at[value]), pa.array(a, mask=np.isnan(a)).cast(v.type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, 2):
            out = filtered(b)
            yield from (out.slice(i, 20_000) for i in range(0, out.num_rows, 20_000))

    rows = (dense if placed else by_slice(dense, by)).select(*names)
    return rows.mapInArrow(run, rows.schema).select(*dense.columns)


def disk_extreme(
    dense: DataFrame, value: str, radius: int, largest: bool, by: str = "pid", placed: bool = False
) -> DataFrame:
    """Replace the value by its maximum (dilation) or minimum (erosion) over a disk in the slice."""
    return disk_chain(dense, value, [(radius, largest)], by, placed)


def dilate_disk(dense: DataFrame, value: str, radius: int, by: str = "pid", placed: bool = False) -> DataFrame:
    return disk_extreme(dense, value, radius, True, by, placed)


def erode_disk(dense: DataFrame, value: str, radius: int, by: str = "pid", placed: bool = False) -> DataFrame:
    return disk_extreme(dense, value, radius, False, by, placed)


def open_disk(dense: DataFrame, value: str, radius: int, by: str = "pid", placed: bool = False) -> DataFrame:
    return disk_chain(dense, value, [(radius, False), (radius, True)], by, placed)


def close_disk(dense: DataFrame, value: str, radius: int, by: str = "pid", placed: bool = False) -> DataFrame:
    """Maximum, then minimum: for grey values and masks alike."""
    return disk_chain(dense, value, [(radius, True), (radius, False)], by, placed)


# --- sparse 3-D structures -------------------------------------------------------------------


def cube_offsets(size: int = 2) -> list[tuple[int, int, int]]:
    """A cube; an even size reaches one further back than forward."""
    low = -(size // 2)
    return list(itertools.product(range(low, low + size), repeat=3))


def neighbour_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Centre and neighbours that differ in at most ``connectivity`` coordinates."""
    return [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) <= connectivity]


def _shifted(a: np.ndarray, off: Sequence[int], none: bool) -> np.ndarray:
    """b[p] = a[p - off]."""
    out = np.full_like(a, none)
    to = tuple(slice(max(0, o), min(n, n + o)) for o, n in zip(off, a.shape))
    at = tuple(slice(max(0, -o), min(n, n - o)) for o, n in zip(off, a.shape))
    out[to] = a[at]
    return out


def _step(a: np.ndarray, grid: np.ndarray, offsets: Sequence[tuple[int, int, int]], grow: bool) -> np.ndarray:
    """One dilation or erosion of a set inside the grid; of an erosion no place is left that touches no set voxel."""
    if grow:
        return np.logical_or.reduce([_shifted(a, o, False) for o in offsets]) & grid
    back = [[-v for v in o] for o in offsets]
    every = np.logical_and.reduce([_shifted(a | ~grid, o, True) for o in back])
    return every & grid & np.logical_or.reduce([_shifted(a & grid, o, False) for o in back])


def structure_chain(
    mask: DataFrame, steps: Sequence[tuple[Sequence[tuple[int, int, int]], bool]], shape: Sequence[int | Column], by: Sequence[str] = ("pid",)
) -> DataFrame:
    """Dilations (True) and erosions (False) by small structures, one after the other on the bricks of a sparse mask.

    A voxel travels to the bricks it can reach in all steps together, as one small row each; every brick answers for its own
    voxels. Nothing else is shuffled, and no row stands for a voxel and an offset. ``shape``: numbers or columns that depend on ``by`` alone.
    """
    by, steps = list(by), [([tuple(o) for o in offsets], grow) for offsets, grow in steps]
    far = [sum(max(abs(o[i]) for o in offsets) for offsets, _ in steps) for i in range(3)]
    sizes = [(n if isinstance(n, Column) else F.lit(n)).cast("int") for n in shape]
    low = [F.greatest(F.col(c) - r, F.lit(0)) for c, r in zip(AXES, far)]
    high = [F.least(F.col(c) + r, n - 1) for c, r, n in zip(AXES, far, sizes)]
    carried = [*[F.col(c).cast("int").alias(f"__c{c}") for c in AXES], *[n.alias(f"__cn{c}") for n, c in zip(sizes, AXES)]]
    set_ = mask.filter(" and ".join(f"{c} is not null" for c in AXES))
    m, pad = len(by) + 1, np.array(far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, m):
            starts = np.flatnonzero(~same_as_before(b.columns[:m]))
            code = b.column(m - 1).to_numpy()
            at = np.stack([b.column(m + i).to_numpy() for i in range(3)]).astype(np.int64)
            n = np.stack([b.column(m + 3 + i).to_numpy() for i in range(3)])
            found = []
            for lo, hi in zip(starts, np.append(starts[1:], b.num_rows)):
                first, size = origin(int(code[lo])), n[:, lo]
                p = at[:, lo:hi]
                zero = p.min(axis=1) - pad
                a = np.zeros(p.max(axis=1) + pad - zero + 1, bool)
                a[tuple(p - zero[:, None])] = True
                own, grid = [], []
                for i in range(3):
                    place = np.arange(zero[i], zero[i] + a.shape[i])
                    grid.append((place >= 0) & (place < size[i]))
                    own.append((place >= first[i]) & (place < first[i] + EDGE))
                grid = grid[0][:, None, None] & grid[1][None, :, None] & grid[2][None, None, :]
                for offsets, grow in steps:
                    a = _step(a, grid, offsets, grow)
                a &= own[0][:, None, None] & own[1][None, :, None] & own[2][None, None, :]
                found.append(np.argwhere(a) + zero)
            rows = pa.array(np.repeat(starts, [len(f) for f in found]))
            places = np.concatenate(found).astype(np.int32)
            out = pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(m - 1)], *[pa.array(np.ascontiguousarray(c)) for c in places.T]], [*by, *AXES])
            yield from (out.slice(i, 50_000) for i in range(0, out.num_rows, 50_000))

    schema = ", ".join([*[f"`{c}` {mask.schema[c].dataType.simpleString()}" for c in by], *[f"{c} int" for c in AXES]])
    return to_bricks(set_, by, low, high, carried).mapInArrow(run, schema)


def dilate(mask: DataFrame, offsets: Sequence[tuple[int, int, int]], shape: Sequence[int | Column], by: Sequence[str] = ("pid",)) -> DataFrame:
    """Voxels p with some set voxel at p - offset."""
    return structure_chain(mask, [(offsets, True)], shape, by)


def erode(mask: DataFrame, offsets: Sequence[tuple[int, int, int]], shape: Sequence[int | Column], by: Sequence[str] = ("pid",)) -> DataFrame:
    """Voxels p with every p + offset set or outside the grid."""
    return structure_chain(mask, [(offsets, False)], shape, by)


def opening(mask: DataFrame, offsets: Sequence[tuple[int, int, int]], shape: Sequence[int | Column], by: Sequence[str] = ("pid",)) -> DataFrame:
    """Erosion, then the matching dilation: what the structure can cover from inside."""
    return structure_chain(mask, [(offsets, False), (offsets, True)], shape, by)
