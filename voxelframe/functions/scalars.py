"""Column builders: identifiers, intensity scales, label curves and small numeric helpers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Intensity range and the malignancy prior by diameter in mm.
MIN_HU = -1000.0
MAX_HU = 400.0
AIR_THRESHOLD = -350.0
DIAMETER_PRIOR = [
    (0.0, 0.0),
    (5.0, 0.035),
    (10.0, 0.28),
    (20.0, 0.64),
    (25.0, 0.82),
    (30.0, 0.93),
    (40.0, 0.97),
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


# --- identifiers -----------------------------------------------------------------------------


def pid_from_dir(path: Column | str) -> Column:
    """Last path token; trailing slashes do not count."""
    return F.element_at(F.split(F.rtrim(_c(path), F.lit("/")), "/"), -1)


def pid_from_file(path: Column | str, extension: str = ".mhd") -> Column:
    """File name without the extension and without ``.pkl``, wherever they occur in it."""
    base = F.substring_index(_c(path), "/", -1)
    return F.replace(F.replace(base, F.lit(extension), F.lit("")), F.lit(".pkl"), F.lit(""))


def slice_id(name: Column | str) -> Column:
    return F.substring_index(_c(name), ".", 1)


# --- intensities -----------------------------------------------------------------------------


def ct_to_hu(raw: Column | str, slope: Column | str, intercept: Column | str) -> Column:
    return F.greatest(_c(slope) * _c(raw) + _c(intercept), F.lit(MIN_HU))


def hu_norm_no_clip(hu: Column | str) -> Column:
    return (_c(hu) - F.lit(MIN_HU)) / F.lit(MAX_HU - MIN_HU)


def hu_norm(hu: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return clip(hu_norm_no_clip(hu), low, high)


def hu_norm_array(hu: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """:func:`hu_norm` of an array of doubles; nan counts as largest, as it does there."""
    unit = (hu - MIN_HU) / (MAX_HU - MIN_HU)
    return np.where(np.isnan(unit), high, np.clip(unit, low, high))


def hu_norm_low_clip(hu: Column | str) -> Column:
    return hu_norm(hu, 0.0, 10.0)


def pixel_norm(hu: Column | str) -> Column:
    return (hu_norm(hu) - F.lit(0.5)) / F.lit(0.5)


def zmuv(x: Column | str, mean: Column, std: Column) -> Column:
    """Zero mean, unit variance; the value itself when either parameter is NULL."""
    return F.when(mean.isNotNull() & std.isNotNull(), (_c(x) - mean) / std).otherwise(_c(x))


# --- positions -------------------------------------------------------------------------------


def world_to_voxel(world: Column | str, origin: Column | str, spacing: Column | str) -> Column:
    """Distance from the origin in voxels; the absolute value is part of the definition."""
    return F.abs(_c(world) - _c(origin)) / _c(spacing)


def slice_position(orientation: Column | str, position: Column | str) -> Column:
    """Projection of the position on the normal of the slice plane."""
    o, p = _c(orientation), _c(position)
    r = [o[i] for i in range(3)]
    c = [o[i] for i in range(3, 6)]
    normal = [r[1] * c[2] - r[2] * c[1], r[2] * c[0] - r[0] * c[2], r[0] * c[1] - r[1] * c[0]]
    return p[0] * normal[0] + p[1] * normal[1] + p[2] * normal[2]


def mid_pixel_position(
    orientation: Column | str,
    position: Column | str,
    spacing: Column | str,
    rows: Column | str,
    cols: Column | str,
) -> Column:
    """Patient-space coordinates of the centre pixel, as an array of three."""
    o, p, s = _c(orientation), _c(position), _c(spacing)
    i = _c(cols) / F.lit(2.0) * s[0]
    j = _c(rows) / F.lit(2.0) * s[1]
    return F.array(*[i * o[k] + j * o[3 + k] + p[k] for k in range(3)])


def scale_patch_location(c: Column | str, size: float = 512.0) -> Column:
    return _c(c) / F.lit(size)


# --- label curves and bins -------------------------------------------------------------------


def diameter_to_prob(diameter: Column | str) -> Column:
    """Prior probability of malignancy: linear between the fixed knots, extended past the last."""
    d = _c(diameter)
    out = None
    for (x0, p0), (x1, p1) in zip(DIAMETER_PRIOR, DIAMETER_PRIOR[1:]):
        piece = F.lit(p0) + (d - F.lit(x0)) * F.lit((p1 - p0) / (x1 - x0))
        if x1 == DIAMETER_PRIOR[-1][0]:
            out = out.otherwise(piece)
        else:
            out = F.when(d < x1, piece) if out is None else out.when(d < x1, piece)
    return clip(out, 0.0, 1.0)


def digitize(x: Column | str, borders: Sequence[float]) -> Column:
    """Number of (increasing) borders at or below the value."""
    x = _c(x)
    total = F.lit(0)
    for b in borders:
        total = total + (x >= F.lit(float(b))).cast("int")
    return total


def size_bin(diameter: Column | str, borders: Sequence[float], overflow: str = "last") -> Column:
    """0 for no nodule, else 1 + index of the first border above the diameter.

    A diameter beyond all borders goes to the bin after the last border (``'last'``) or, as the
    original label code had it, to bin 1 (``'first'``).
    """
    d = _c(diameter)
    out = F.when(d <= 0, F.lit(0))
    for i, b in enumerate(borders):
        out = out.when(d < F.lit(float(b)), F.lit(1 + i))
    return out.otherwise(F.lit(1 if overflow == "first" else 1 + len(borders)))


def logodds_to_p(lo: Column | str) -> Column:
    lo = _c(lo)
    odds = F.exp(clip(lo, -500.0, 500.0))
    return F.when(lo < -500, F.lit(0.0)).when(lo > 500, F.lit(1.0)).otherwise(odds / (1 + odds))


# --- feature vectors -------------------------------------------------------------------------


class HeadLayout:
    """Named heads stored one after the other in a feature array."""

    def __init__(self, heads: Sequence[tuple[str, str, int]]):
        self.heads = {}
        start = 1
        for name, kind, width in heads:
            self.heads[name] = (start, kind, width)
            start += width
        self.width = start - 1

    def get(self, features: Column | str, name: str) -> Column:
        """The head: an array for a classification head, a number otherwise."""
        start, kind, width = self.heads[name]
        if kind == "classification":
            return F.slice(_c(features), start, width)
        return F.element_at(_c(features), start)

    def unit(self, features: Column | str, name: str, index: int) -> Column:
        """One unit (0-based) of a head."""
        start, _, width = self.heads[name]
        if not 0 <= index < width:
            raise IndexError(f"head {name} has {width} units")
        return F.element_at(_c(features), start + index)


def weighted_sum(features: Column | str, weights: Sequence[float]) -> Column:
    """Dot product with fixed weights, unrolled so that it stays inside code generation."""
    f = _c(features)
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.element_at(f, i + 1).cast("double") * F.lit(float(w))
    return total


def swap_axes(flat: Column | str, shape: Sequence[int], first: int, second: int) -> Column:
    """Flat row-major array of ``shape`` with two axes exchanged, again flat row-major."""
    strides = [1] * len(shape)
    for i in range(len(shape) - 2, -1, -1):
        strides[i] = strides[i + 1] * shape[i + 1]
    out_shape, src_strides = list(shape), list(strides)
    out_shape[first], out_shape[second] = out_shape[second], out_shape[first]
    src_strides[first], src_strides[second] = src_strides[second], src_strides[first]
    out_strides = [1] * len(shape)
    for i in range(len(shape) - 2, -1, -1):
        out_strides[i] = out_strides[i + 1] * out_shape[i + 1]
    n = out_strides[0] * out_shape[0]
    arr = _c(flat)

    def source(i: Column) -> Column:
        pos = F.lit(0)
        for k in range(len(shape)):
            index = F.floor(i / F.lit(out_strides[k])).cast("int") % F.lit(out_shape[k])
            pos = pos + index * F.lit(src_strides[k])
        return F.element_at(arr, (pos + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), source)


# --- text ------------------------------------------------------------------------------------


def experiment_id(name: Column | str, at: Column | str) -> Column:
    return F.concat_ws("-", _c(name), F.date_format(_c(at), "yyyyMMdd-HHmmss"))


def hms(seconds: Column | str) -> Column:
    """``HH:MM:SS`` of a number of seconds, hours unbounded."""
    s = F.floor(_c(seconds)).cast("long")
    hours = F.floor(s / 3600).cast("long")
    minutes = F.floor((s % 3600) / 60).cast("long")
    return F.format_string("%02d:%02d:%02d", hours, minutes, (s % 60).cast("long"))


def eta_seconds(
    elapsed: Column | str, index: Column | str, total: Column | str, start: Column | str
) -> Column:
    """Time left from the mean time per finished chunk."""
    i = _c(index)
    return F.try_divide(_c(elapsed) * (_c(total) - i + F.lit(1.0)), i + F.lit(1.0) - _c(start))
