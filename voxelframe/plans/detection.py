"""Blob detection and lung masks: compositions of the volume operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.scalars import AIR_THRESHOLD
from voxelframe.operators import blobs as B
from voxelframe.operators import components as C
from voxelframe.operators import morphology as M
from voxelframe.operators import scalespace as S
from voxelframe.operators.volume import densify
from voxelframe.session import cut

AXES = ("z", "y", "x")


def _detect(voxels, shapes, sigmas, form, threshold, overlap, value, by, slab, dtype) -> DataFrame:
    peaks = S.local_maxima(voxels, shapes, sigmas, form, threshold, value, by, slab, dtype)
    # ids follow the raster order of (z, y, x, level)
    code = C.packed(*[F.col(c) for c in AXES]) * F.lit(len(sigmas) + 1) + F.col("level")
    blobs = peaks.select(by, code.alias("cid"), *[F.col(c).cast("double").alias(c) for c in AXES], "sigma")
    # pruning reads the blobs from both sides; the scale space must not be computed twice
    return B.prune(cut(blobs), overlap, by)


def detect_blobs_dog(
    voxels: DataFrame, shapes: DataFrame, min_sigma: float = 1.0, max_sigma: float = 50.0, ratio: float = 1.6,
    threshold: float = 2.0, overlap: float = 0.5, value: str = "v", by: str = "pid", slab: int = S.SLAB, dtype: str = "float32",
) -> DataFrame:
    """(by, cid, z, y, x, sigma): maxima of the difference of gaussians, pruned by overlap."""
    return _detect(voxels, shapes, S.dog_sigmas(min_sigma, max_sigma, ratio), "dog", threshold, overlap, value, by, slab, dtype)


def detect_blobs_log(
    voxels: DataFrame, shapes: DataFrame, min_sigma: float = 1.0, max_sigma: float = 50.0, n_sigma: int = 10,
    threshold: float = 0.2, overlap: float = 0.5, log_scale: bool = False, value: str = "v", by: str = "pid",
    slab: int = S.SLAB, dtype: str = "float32",
) -> DataFrame:
    """The same with the Laplacian of gaussian."""
    sigmas = S.log_sigmas(min_sigma, max_sigma, n_sigma, log_scale)
    return _detect(voxels, shapes, sigmas, "log", threshold, overlap, value, by, slab, dtype)


# --- lung masks ------------------------------------------------------------------------------


def _dense_mask(shapes: DataFrame, mask: DataFrame, by: str) -> DataFrame:
    return densify(mask.withColumn("m", F.lit(1)), shapes, "m", by)


def _sizes(df: DataFrame, shapes: DataFrame, by: str) -> DataFrame:
    return df.join(shapes.select(by, "nz", "ny", "nx"), by)


def _cleared(mask: DataFrame, shapes: DataFrame, by: str) -> DataFrame:
    sized = _sizes(mask, shapes, by)
    keep = [by, "nz", "ny", "nx"]
    return C.clear_border(sized, F.col("ny"), F.col("nx"), keep).select(by, *AXES)


def lung_mask_hull(
    voxels: DataFrame, shapes: DataFrame, threshold: float = AIR_THRESHOLD, radius: int = 5, value: str = "hu", by: str = "pid"
) -> DataFrame:
    """Air not touching the slice edge, opened by a disk, and its convex hull per slice."""
    air = _cleared(voxels.filter(F.col(value) < threshold).select(by, *AXES), shapes, by)
    opened = M.open_disk(_dense_mask(shapes, air, by), "m", radius, by, placed=True)
    return C.convex_hull(opened.filter("m > 0").select(by, *AXES), "z", [by])


def _body_values(
    dense: DataFrame, threshold: float, body: int, close: int, value: str, by: str, placed: bool, after: Sequence[tuple[int, bool]] = ()
) -> DataFrame:
    """Values inside the filled and eroded body (0 outside), closed by a small disk, then the disks ``after``; one placement by slices serves all."""
    rows = dense if placed else M.by_slice(dense, by)
    marked = C.mark_filled(rows, F.col(value) > threshold, F.col("ny"), F.col("nx"), [by], "__in", placed=True)
    core = M.erode_disk(marked, "__in", body, by, placed=True)
    inside = core.withColumn(value, F.col(value) * F.col("__in")).drop("__in")
    return M.disk_chain(inside, value, [(close, True), (close, False), *after], by, placed=True)


def lung_mask_body(
    dense: DataFrame, threshold: float = AIR_THRESHOLD, body: int = 8, close: int = 2, wall: int = 13, value: str = "hu",
    by: str = "pid", placed: bool = False,
) -> DataFrame:
    """Air inside the body, freed of vessels by a grey closing and widened by a grey erosion.

    ``dense`` has every grid position with its value and the columns nz, ny, nx; ``placed``: it comes from ``densify``.
    """
    worn = _body_values(dense, threshold, body, close, value, by, placed, [(wall, False)])
    return worn.filter(F.col(value) < threshold).select(by, *AXES)


def lung_mask_linked(
    dense: DataFrame, threshold: float = AIR_THRESHOLD, body: int = 8, close: int = 2, grow: int = 13, min_pixels: int = 7,
    min_share: float = 0.015, value: str = "hu", by: str = "pid", placed: bool = False, shapes: DataFrame | None = None,
) -> DataFrame:
    """Air inside the body, kept where linked slice by slice to the middle, then dilated.

    ``shapes`` (by, nz, ny, nx) saves looking them up in ``dense``.
    """
    closed = _body_values(dense, threshold, body, close, value, by, placed)
    air = closed.filter(F.col(value) < threshold)
    linked = C.prune_by_overlap(air, F.floor(F.col("nz") / 2), min_pixels, min_share, by)
    if shapes is None:
        shapes = dense.select(by, "nz", "ny", "nx").distinct()
    return M.dilate_disk(_dense_mask(shapes, linked, by), "m", grow, by, placed=True).filter("m > 0").select(by, *AXES)


def lung_mask_region(
    voxels: DataFrame, shapes: DataFrame, threshold: float = AIR_THRESHOLD, min_area: int = 300, value: str = "hu",
    by: str = "pid", brick: int = 64,
) -> DataFrame:
    """Hull of the largest air region, minus hulls of other large regions that do not touch it."""
    air = _cleared(voxels.filter(F.col(value) < threshold).select(by, *AXES), shapes, by)
    sized = _sizes(air, shapes, by)
    n = [F.col("nz"), F.col("ny"), F.col("nx")]
    wide = [by, "nz", "ny", "nx"]
    opened = cut(M.opening(sized, M.cube_offsets(2), n, wide))
    lung = C.keep_largest(C.label_volume(opened.select(by, *AXES), [by], brick=brick), [by]).select(by, *AXES)
    lung = cut(lung)
    hull = cut(C.convex_hull(lung, "x", [by]))
    rest = cut(C.label_volume(opened.select(by, *AXES).join(hull, [by, *AXES], "left_semi"), [by], brick=brick))
    main = C.largest_label(rest, [by])
    large = rest.groupBy(by, "label").agg(F.count(F.lit(1)).alias("area")).filter(F.col("area") > min_area)
    others = rest.join(large.join(main, [by, "label"], "left_anti"), [by, "label"], "left_semi")
    grown = M.dilate(_sizes(others, shapes, by), M.neighbour_offsets(2), n, [by, "label", "nz", "ny", "nx"]).select(by, "label", *AXES)
    touching = grown.join(lung, [by, *AXES], "left_semi").select(by, "label").distinct()
    foreign = grown.join(touching, [by, "label"], "left_anti")
    holes = C.convex_hull(foreign, "z", [by, "label"]).select(by, *AXES)
    return hull.join(holes, [by, *AXES], "left_anti")
