"""Whole stages of a scan pipeline as functions of tables, with the model as an argument.

Both stages resume: patients with a stored result are left out before any work, and their results stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions import affine as A
from voxelframe.functions.hashing import uniform
from voxelframe.functions.scalars import hu_norm, hu_norm_array
from voxelframe.operators import blobs as B
from voxelframe.operators import joins as J
from voxelframe.operators import ranking as RK
from voxelframe.operators import scoring as SC
from voxelframe.operators import volume as V
from voxelframe.plans import detection as D
from voxelframe.session import cut

AXES = ("z", "y", "x")


def jittered(candidates: DataFrame, n: int, reach: float, seed: str, by: str = "pid", cid: str = "cid") -> DataFrame:
    """Each candidate ``n`` times, moved along every axis by a draw within ``reach`` voxels, with its replica number."""
    replicas = J.replicate(candidates, n)
    move = {c: F.col(c) + (uniform(f"{seed}-{c}", by, cid, "replica") * 2 - 1) * F.lit(float(reach)) for c in AXES}
    return replicas.withColumns(move)


def stage_scores(
    candidates: DataFrame, voxels: DataFrame, shapes: DataFrame, spacing: Sequence[Column | float], patch: Sequence[int],
    patch_mm: Sequence[float], scorer: SC.Scorer, done: DataFrame | None = None, n_replicas: int = 1, reach: float = 0.0,
    seed: str = "replica", distance: float = B.MERGE_DISTANCE, z_scale: float = B.MERGE_Z_SCALE, value: str = "hu",
    by: str = "pid", cid: str = "cid",
) -> DataFrame:
    """Candidates still to do → replicas → patches → scores → mean → merged → ranked.

    Returns (by, cid, z, y, x, p, n_replicas, rank). A scorer gets patches of normalised intensities as flat arrays.
    """
    todo = candidates.select(by, cid, *AXES)
    if done is not None:
        todo = J.exclude_done(todo, done.select(by).distinct(), by)
    replicas = jittered(todo, n_replicas, reach, seed, by, cid).withColumn("__rid", F.struct(F.col(cid).alias("cid"), "replica"))
    scans = J.keep_known(voxels, todo.select(by).distinct(), by)
    patches = V.whole_patches(replicas.select(by, "__rid", *AXES), scans, shapes, spacing, patch, patch_mm, "__rid", value, by, change=hu_norm_array)
    scored = SC.score_patches(patches, scorer, value, keep=(by, "__rid"))
    means = SC.average_replicas(scored.select(by, F.col("__rid.cid").alias(cid), "p"), [by, cid])
    placed = cut(todo.join(means, [by, cid]))  # scored once; the merge reads it several times
    merged = B.merge_close(placed, distance, z_scale, by, cid, "p")
    return RK.rank_candidates(merged, "p", by, cid)


def stage_candidates(
    voxels: DataFrame, mask: DataFrame, shapes: DataFrame, spacing: Sequence[float], grid: Sequence[int],
    grid_mm: Sequence[float], segment: Callable[[DataFrame], DataFrame], window: int, stride: int,
    done: DataFrame | None = None, min_sigma: float = 1.0, max_sigma: float = 15.0, threshold: float = 0.1,
    overlap: float = 0.5, value: str = "hu", by: str = "pid",
) -> DataFrame:
    """Scans still to do → common grid with mask → tiles → segmentation → stitched → blobs → source voxels.

    ``segment`` maps a table of tile voxels (by, tz, ty, tx, lz, ly, lx, v: normalised intensity) to the same rows with
    the model's output as ``v``. What lies outside the mask counts as 0. Returns (by, cid, z, y, x, sigma) with positions
    in voxels of the source scan.
    """
    todo = shapes if done is None else J.exclude_done(shapes, done, by)
    scans, inside = J.keep_known(voxels, todo, by), J.keep_known(mask, todo, by)
    # scan and mask fill the same grid: they need not meet before the mask is used, and each is resampled once
    placed = V.transform_scan(scans, todo, spacing, grid, grid_mm, value, by)
    allowed = V.transform_mask(inside, todo, spacing, grid, grid_mm, by=by)
    tiles = V.tile(placed.select(by, *AXES, hu_norm(F.col(value)).alias("v")), grid, window, stride).drop(*AXES)
    scored = V.stitch(segment(tiles), grid, window, stride, "v", by)
    masked = scored.join(allowed, [by, *AXES], "left_semi")
    sizes = todo.select(by, *[F.lit(n).alias(f"n{c}") for c, n in zip(AXES, grid)])
    blobs = D.detect_blobs_dog(masked, sizes, min_sigma, max_sigma, threshold=threshold, overlap=overlap, value="v", by=by)
    found = blobs.join(todo.select(by, *[f"n{c}" for c in AXES]), by)
    source = A.apply(A.scan_map([F.col(f"n{c}") for c in AXES], spacing, grid, grid_mm), [F.col(c) for c in AXES])
    return found.select(by, "cid", *[p.alias(c) for p, c in zip(source, AXES)], "sigma")
