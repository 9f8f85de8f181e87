"""Affine maps as matrices of numbers or Columns.

A map is a 4 x 4 matrix in output-to-input direction: the matrix times an output voxel is the source
position. Entries are Python floats where they are constant (so products fold on the driver) and
Columns where they depend on the row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Entry = float | Column
Matrix = list[list[Entry]]


def _is(x: Entry, v: float) -> bool:
    return not isinstance(x, Column) and x == v


def _mul(a: Entry, b: Entry) -> Entry:
    if _is(a, 0.0) or _is(b, 0.0):
        return 0.0
    if _is(a, 1.0):
        return b
    if _is(b, 1.0):
        return a
    return a * b


def _add(a: Entry, b: Entry) -> Entry:
    if _is(a, 0.0):
        return b
    if _is(b, 0.0):
        return a
    return a + b


def _neg(a: Entry) -> Entry:
    return _mul(-1.0, a) if isinstance(a, Column) else -a + 0.0


def _inv(a: Entry) -> Entry:
    return F.lit(1.0) / a if isinstance(a, Column) else 1.0 / a


def as_column(x: Entry) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def identity() -> Matrix:
    return [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]


def product(*matrices: Matrix) -> Matrix:
    out = matrices[0]
    for m in matrices[1:]:
        rows = []
        for i in range(4):
            row = []
            for j in range(4):
                total: Entry = 0.0
                for k in range(4):
                    total = _add(total, _mul(out[i][k], m[k][j]))
                row.append(total)
            rows.append(row)
        out = rows
    return out


def _rotation(first: int, second: int, degrees: Entry) -> Matrix:
    """Rotation in the plane of two axes."""
    if isinstance(degrees, Column):
        angle = F.radians(degrees)
        c, s = F.cos(angle), F.sin(angle)
    else:
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    m = identity()
    m[first][first], m[first][second] = c, _neg(s)
    m[second][first], m[second][second] = s, c
    return m


def affine(
    scale: Sequence[Entry] | None = None,
    rotation: Sequence[Entry] | None = None,
    translation: Sequence[Entry] | None = None,
) -> Matrix:
    """Map that undoes the given change: coordinates over the scale minus the translation, then the
    rotations (degrees, about z, y, x)."""
    m = identity()
    for i in range(3):
        if scale is not None:
            m[i][i] = _inv(scale[i])
        if translation is not None:
            m[i][3] = _neg(translation[i])
    if rotation is not None:
        about_z, about_y, about_x = rotation
        m = product(_rotation(1, 0, about_x), _rotation(0, 2, about_y), _rotation(1, 2, about_z), m)
    return m


def patch_map(
    centre: Sequence[Entry],
    spacing: Sequence[Entry],
    patch: Sequence[int],
    patch_mm: Sequence[float],
    out_spacing: Sequence[float] = (1.0, 1.0, 1.0),
    rotation: Sequence[Entry] | None = None,
    translation: Sequence[Entry] | None = None,
) -> Matrix:
    """Patch voxel to scan voxel, for a patch around a centre given in scan voxels.

    The scan is taken to millimetres, centred, augmented, uncentred and scaled to the patch grid.
    """
    ratio = [_mul(s, 1.0 / o) for s, o in zip(spacing, out_spacing)]
    chain = [
        affine(scale=ratio),
        affine(translation=[_neg(_mul(c, r)) for c, r in zip(centre, ratio)]),
    ]
    if rotation is not None or translation is not None:
        chain.append(affine(rotation=rotation or [0.0] * 3, translation=translation or [0.0] * 3))
    chain += [
        affine(translation=[m / 2.0 for m in patch_mm]),
        affine(scale=[n / m for n, m in zip(patch, patch_mm)]),
    ]
    return product(*chain)


def scan_map(
    shape: Sequence[Entry], spacing: Sequence[Entry], patch: Sequence[int], patch_mm: Sequence[float], **kw
) -> Matrix:
    """The map of a whole scan: a patch around the scan's middle."""
    return patch_map([_mul(n, 0.5) for n in shape], spacing, patch, patch_mm, **kw)


def apply(m: Matrix, point: Sequence[Entry]) -> list[Column]:
    out = []
    for i in range(3):
        total = m[i][3]
        for k in range(3):
            total = _add(total, _mul(m[i][k], point[k]))
        out.append(as_column(total))
    return out


def inverse(m: Matrix) -> Matrix:
    """Inverse through the adjugate of the linear part."""

    def minor(i: int, j: int) -> Entry:
        r = [k for k in range(3) if k != i]
        c = [k for k in range(3) if k != j]
        return _add(_mul(m[r[0]][c[0]], m[r[1]][c[1]]), _neg(_mul(m[r[0]][c[1]], m[r[1]][c[0]])))

    def signed(i: int, j: int) -> Entry:
        return minor(i, j) if (i + j) % 2 == 0 else _neg(minor(i, j))

    det: Entry = 0.0
    for j in range(3):
        det = _add(det, _mul(m[0][j], signed(0, j)))
    over = _inv(det)
    out = identity()
    for i in range(3):
        for j in range(3):
            out[i][j] = _mul(signed(j, i), over)
    for i in range(3):
        shift: Entry = 0.0
        for k in range(3):
            shift = _add(shift, _mul(out[i][k], m[k][3]))
        out[i][3] = _neg(shift)
    return out


def to_columns(m: Matrix, prefix: str = "m") -> list[Column]:
    """The three rows as twelve named columns."""
    return [as_column(m[i][j]).alias(f"{prefix}{i}{j}") for i in range(3) for j in range(4)]


def from_columns(prefix: str = "m") -> Matrix:
    rows: Matrix = [[F.col(f"{prefix}{i}{j}") for j in range(4)] for i in range(3)]
    return rows + [[0.0, 0.0, 0.0, 1.0]]


def scaled_diameter(
    diameter: Column, patch: Sequence[int], patch_mm: Sequence[float], out_spacing: Sequence[float] = (1.0, 1.0, 1.0)
) -> Column:
    return diameter * F.lit(patch[1] / patch_mm[1] / out_spacing[1])


def rint(x: Column) -> Column:
    """Round half to even, never minus zero."""
    return F.rint(x) + F.lit(0.0)
