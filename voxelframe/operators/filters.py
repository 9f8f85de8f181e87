"""Row predicates and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.scalars import AIR_THRESHOLD


def cutoff(score: Column | str, threshold: float, value: Column | None = None) -> Column:
    """The value (default: the score) when the score reaches the threshold, else NULL.

    The row stays: a low-scoring candidate leaves an empty slot, it is not filtered away.
    """
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= F.lit(float(threshold)), s if value is None else value)


def below(voxels: DataFrame, value: str = "hu", threshold: float = AIR_THRESHOLD) -> DataFrame:
    """Voxels under the threshold, as a sparse mask."""
    return voxels.filter(F.col(value) < F.lit(threshold))


def apply_mask(
    voxels: DataFrame, mask: DataFrame, value: str, keys: Sequence[str] = ("pid", "z", "y", "x")
) -> DataFrame:
    """Multiply by a sparse 0/1 mask: the value inside, zero outside."""
    inside = mask.select(*keys, F.lit(1.0).alias("__m"))
    return (
        voxels.join(inside, list(keys), "left")
        .withColumn(value, F.col(value) * F.coalesce("__m", F.lit(0.0)))
        .drop("__m")
    )


def patch_inside(centre: Sequence[str], shape: Sequence[int | Column], patch: int) -> Column:
    """Is the rounded centre more than half a patch away from every border?"""
    half = patch // 2
    ok = F.lit(True)
    for c, n in zip(centre, shape):
        n = n if isinstance(n, Column) else F.lit(n)
        r = F.bround(F.col(c))
        ok = ok & (r > half) & (r < n - half)
    return ok


def require_binary(labels: DataFrame, label: str = "label") -> DataFrame:
    """Fail the job on a label other than 0 or 1 (NULL included)."""
    bad = F.concat(F.lit("label is not 0 or 1: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))
    checked = F.when(F.col(label).isin(0, 1), F.col(label)).otherwise(F.raise_error(bad).cast("int"))
    return labels.withColumn(label, checked)


def quarantine(labels: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """The same guard as a split: (valid rows, other rows)."""
    ok = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    return labels.filter(ok), labels.filter(~ok)


def grid_compatible(
    left: Sequence[Column], right: Sequence[Column], tolerance: float = 1e-9
) -> Column:
    """Sum of absolute differences below the tolerance."""
    total = F.lit(0.0)
    for a, b in zip(left, right):
        total = total + F.abs(a - b)
    return total < F.lit(tolerance)
