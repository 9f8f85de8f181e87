"""Gaussian scale spaces and their local maxima.

A scan is cut into slabs of planes, each with a halo of as many planes as the widest kernel reaches. Voxel rows are placed by planes and
packed plane by plane, and a packed plane goes to the slabs that need it, so a voxel travels once per slab and not once per scale. A task
smooths its slab along all axes, one scale after the other, with small matrices that already contain the mirrored border; only
the scales around the present one are held, and of :func:`local_maxima` only the maxima leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.plans.bricks import packed_groups, packed_values, same_as_before
from voxelframe.session import sound_unions

# Kernels are cut at this many sigmas.
TRUNCATE = 4.0
SLAB = 64


def dog_sigmas(min_sigma: float = 1.0, max_sigma: float = 50.0, ratio: float = 1.6) -> list[float]:
    """Geometric series up to the first value beyond the maximum."""
    k = int(math.log(max_sigma / min_sigma, ratio)) + 1
    return [min_sigma * ratio**i for i in range(k + 1)]


def log_sigmas(min_sigma: float = 1.0, max_sigma: float = 50.0, n: int = 10, log_scale: bool = False) -> list[float]:
    if log_scale:
        return [float(s) for s in np.logspace(math.log10(min_sigma), math.log10(max_sigma), n)]
    return [float(s) for s in np.linspace(min_sigma, max_sigma, n)]


def kernel(sigma: float, derivative: int = 0) -> np.ndarray:
    """Sampled gaussian (or its second derivative), normalised before the derivative is taken."""
    radius = int(TRUNCATE * sigma + 0.5)
    at = np.arange(-radius, radius + 1, dtype=float)
    w = np.exp(-0.5 * (at / sigma) ** 2)
    w /= w.sum()
    if derivative == 2:
        w = w * (at**2 / sigma**4 - 1 / sigma**2)
    return w


def smoothing_matrix(n: int, sigma: float, derivative: int = 0) -> np.ndarray:
    """(n, n): row o holds the weights of output o, positions beyond the ends mirrored back."""
    w = kernel(sigma, derivative)
    radius = len(w) // 2
    out = np.zeros((n, n))
    at = np.arange(n)
    for k, weight in zip(range(-radius, radius + 1), w):
        source = (at + k) % (2 * n)
        source = np.where(source < n, source, 2 * n - 1 - source)
        np.add.at(out, (at, source), weight)
    return out


class Slab:
    """Planes ``first`` to ``last`` of a scan, and those around them that smoothing reads."""

    def __init__(self, shape: Sequence[int], first: int, last: int, reach: int, dtype: str):
        self.shape, self.first, self.last, self.dtype = tuple(shape), first, last, dtype
        nz = self.shape[0]
        # one more plane on each side, to compare with
        self.out = max(0, first - 1), min(nz, last + 1)
        self.low, self.high = max(0, self.out[0] - reach), min(nz, self.out[1] + reach)
        self.img = np.zeros((self.high - self.low, *self.shape[1:]), dtype)
        self.known: dict = {}

    def add(self, z: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
        near = np.flatnonzero((z >= self.low) & (z < self.high))
        z, places = z[near] - self.low, places[near].astype(np.int64)
        np.add.at(self.img.reshape(-1), (z * self.shape[1] + (places >> 16)) * self.shape[2] + (places & 0xFFFF), values[near])

    def matrix(self, axis: int, sigma: float, derivative: int = 0) -> np.ndarray:
        key = axis, sigma, derivative
        if key not in self.known:
            m = smoothing_matrix(self.shape[axis], sigma, derivative)
            self.known[key] = (m[self.out[0] : self.out[1], self.low : self.high] if axis == 0 else m).astype(self.dtype)
        return self.known[key]

    def along_z(self, sigma: float, derivative: int = 0) -> np.ndarray:
        return (self.matrix(0, sigma, derivative) @ self.img.reshape(len(self.img), -1)).reshape(-1, *self.shape[1:])

    def along_yx(self, a: np.ndarray, sigma: float, dy: int = 0, dx: int = 0) -> np.ndarray:
        return np.matmul(np.matmul(self.matrix(1, sigma, dy), a), self.matrix(2, sigma, dx).T)

    def gauss(self, sigma: float) -> np.ndarray:
        return self.along_yx(self.along_z(sigma), sigma)

    def laplacian(self, sigma: float) -> np.ndarray:
        flat = self.along_z(sigma)
        return self.along_yx(self.along_z(sigma, 2), sigma) + self.along_yx(flat, sigma, 2, 0) + self.along_yx(flat, sigma, 0, 2)

    def levels(self, sigmas: Sequence[float], form: str) -> Iterator[np.ndarray]:
        """The scale space on the planes ``out``, level by level."""
        self.known.clear()
        if form == "log":
            for s in sigmas:
                yield -self.laplacian(s) * s**2
        elif form == "gauss":
            for s in sigmas:
                yield self.gauss(s)
        elif form == "dog":
            fine = None
            for i, s in enumerate(sigmas):
                coarse = self.gauss(s)
                if i:
                    yield (fine - coarse) * sigmas[i - 1]
                fine = coarse
        else:
            raise ValueError("form is gauss, dog or log")

    def own(self, a: np.ndarray) -> np.ndarray:
        """Without the planes to compare with."""
        return a[self.first - self.out[0] : self.last - self.out[0]]

    def maxima(self, sigmas: Sequence[float], form: str, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, places, values) of the own planes' values above the threshold that are the largest of their 3^4 neighbourhood."""

        def peaks(level: int, a: np.ndarray, tops: list[np.ndarray]):
            top = self.own(np.maximum.reduce(tops))
            mine = self.own(a)
            at = np.argwhere((mine == top) & (mine > threshold))
            return level, at + [self.first, 0, 0], mine[tuple(at.T)]

        before = now = None
        for level, a in enumerate(self.levels(sigmas, form)):
            top = a
            for axis in range(3):
                top = _neighbour_max(top, axis)
            if now is not None:
                yield peaks(level - 1, now[0], [x[1] for x in (before, now) if x is not None] + [top])
            before, now = now, (a, top)
        if now is not None:
            yield peaks(level, now[0], [x[1] for x in (before, now) if x is not None])


def _neighbour_max(a: np.ndarray, axis: int) -> np.ndarray:
    out = a.copy()
    n = a.shape[axis]
    before, after = [slice(None)] * a.ndim, [slice(None)] * a.ndim
    before[axis], after[axis] = slice(0, n - 1), slice(1, n)
    before, after = tuple(before), tuple(after)
    out[after] = np.maximum(out[after], a[before])
    out[before] = np.maximum(out[before], a[after])
    return out


def plane_pieces(voxels: DataFrame, value: str = "v", by: str = "pid", dtype: str = "float64") -> DataFrame:
    """(by, z, at, v): voxel rows packed by plane, without a shuffle; a place is y * 2^16 + x."""
    slim = voxels.select(by, *[F.col(c).cast("int").alias(c) for c in ("z", "y", "x")], F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))

    def run(batches):
        for b in batches:
            z, y, x = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            got = packed_groups(b.column(0), np.arange(b.num_rows), [z], y << 16 | x, b.column(4).to_numpy(), dtype)
            if got:
                yield pa.RecordBatch.from_arrays(got, [by, "z", "at", "v"])

    return slim.mapInArrow(run, f"`{by}` {slim.schema[by].dataType.simpleString()}, z int, at binary, v binary")


def _over_slabs(voxels: DataFrame, shapes: DataFrame, sigmas: Sequence[float], value: str, by: str, slab: int, dtype: str, answer, columns: str) -> DataFrame:
    """``answer(slab)`` gives columns (a dict) of each slab of each scan; ``columns`` is their schema, ``by`` comes first."""
    reach = max((len(kernel(s)) // 2 for s in sigmas), default=0)
    spark = sound_unions(voxels.sparkSession)
    asked = shapes.select(by, *[F.col(c).cast("int").alias(c) for c in ("nz", "ny", "nx")]).withColumn("slab", F.explode(F.sequence(F.lit(0), F.floor((F.col("nz") - 1) / slab).cast("int"))))
    # whole planes: rows that come in no order would be packed alone, and travel to every slab like that
    pieces = plane_pieces(voxels.repartition(by, "z").sortWithinPartitions(by, "z"), value, by, dtype)
    low = F.greatest(F.ceil((F.col("z") - (reach + slab)) / slab), F.lit(0)).cast("int")
    high = F.floor((F.col("z") + (reach + 1)) / slab).cast("int")
    pieces = pieces.withColumn("slab", F.explode(F.sequence(low, high)))
    none = [F.lit(None).cast("int").alias(c) for c in ("nz", "ny", "nx")]
    both = asked.select(by, "slab", F.lit(0).alias("kind"), "nz", "ny", "nx", F.lit(None).cast("int").alias("z"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("v")).unionByName(
        pieces.select(by, "slab", F.lit(1).alias("kind"), *none, "z", "at", "v")
    )

    def run(batches):
        key, first, held = None, None, None

        def done():
            cols = answer(held)
            n = len(next(iter(cols.values())))
            if n:
                return pa.RecordBatch.from_arrays([first.take(pa.array(np.zeros(n, np.int64))), *[v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()]], [by, *cols])

        for b in batches:
            starts = np.flatnonzero(~same_as_before(b.columns[:3]))
            for lo, hi in zip(starts, np.append(starts[1:], b.num_rows)):
                rows = b.slice(lo, hi - lo)
                here = rows.column(0)[0].as_py(), rows.column(1)[0].as_py()
                if here != key:
                    if held is not None:
                        out = done()
                        if out is not None:
                            yield out
                    key, first, held = here, rows.column(0).slice(0, 1), None
                if rows.column(2)[0].as_py() == 0:
                    shape = [rows.column(i)[0].as_py() for i in (3, 4, 5)]
                    held = Slab(shape, here[1] * slab, min(shape[0], (here[1] + 1) * slab), reach, dtype)
                elif held is not None:  # beyond the last plane there is no slab
                    at = packed_values(rows.column(7), "<i4")
                    n = pc.binary_length(rows.column(7)).to_numpy() // 4
                    held.add(np.repeat(rows.column(6).to_numpy(), n), at, packed_values(rows.column(8), dtype))
        if held is not None:
            out = done()
            if out is not None:
                yield out

    # a fixed number of partitions: the work is in smoothing, not in bytes
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, by, "slab").sortWithinPartitions(by, "slab", "kind")
    return dealt.mapInArrow(run, f"`{by}` {voxels.schema[by].dataType.simpleString()}, {columns}")


def scale_space(
    voxels: DataFrame, shapes: DataFrame, sigmas: Sequence[float], form: str = "gauss", value: str = "v", by: str = "pid",
    slab: int = SLAB, dtype: str = "float64",
) -> DataFrame:
    """(by, z, y, x, level, v) for every grid position.

    ``form``: ``gauss`` smoothed values; ``dog`` differences of successive scales times the finer sigma
    (one level less); ``log`` minus the Laplacian of gaussian times sigma squared. ``shapes`` has
    (by, nz, ny, nx); absent voxels are 0. ``dtype``: in which values travel and are smoothed.
    """
    sigmas = list(sigmas)

    def lines(s: Slab) -> dict:
        space = np.stack([s.own(a) for a in s.levels(sigmas, form)], axis=2).astype(np.float64)
        nz, ny, nl, nx = space.shape
        offs = np.arange(nz * ny * nl + 1) * nx
        return {
            "z": pa.array(np.repeat(np.arange(s.first, s.last), ny * nl), pa.int32()), "y": pa.array(np.tile(np.repeat(np.arange(ny), nl), nz), pa.int32()),
            "level": pa.array(np.tile(np.arange(nl), nz * ny), pa.int32()), "line": pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(space.ravel())),
        }

    out = _over_slabs(voxels, shapes, sigmas, value, by, slab, dtype, lines, "z int, y int, level int, line array<double>")
    return out.select(by, "z", "y", "level", F.posexplode("line").alias("x", "v"))


def local_maxima(
    voxels: DataFrame, shapes: DataFrame, sigmas: Sequence[float], form: str, threshold: float, value: str = "v",
    by: str = "pid", slab: int = SLAB, dtype: str = "float64",
) -> DataFrame:
    """(by, z, y, x, level, sigma, v) where a value above the threshold is the largest of its 3^4
    neighbourhood in space and scale; plateaus keep all their members and borders take part.
    """
    sigmas = list(sigmas)

    def found(s: Slab) -> dict:
        parts = [(np.column_stack((at, np.full(len(at), level))), v) for level, at, v in s.maxima(sigmas, form, threshold)]
        at = np.concatenate([p for p, _ in parts]).astype(np.int32) if parts else np.zeros((0, 4), np.int32)
        v = np.concatenate([x for _, x in parts]).astype(np.float64) if parts else np.zeros(0)
        return dict(zip("zyx", at.T)) | {"level": at[:, 3], "sigma": np.asarray(sigmas, float)[at[:, 3]], "v": v}

    return _over_slabs(voxels, shapes, sigmas, value, by, slab, dtype, found, "z int, y int, x int, level int, sigma double, v double")
