"""Schemas of the input and output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_D, _S, _I, _L = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else False) for f in fields])


SLICES = _struct(
    ("pid", _S), ("sid", _S), ("instance_number", _I), ("orientation", T.ArrayType(T.FloatType())),
    ("position", T.ArrayType(T.FloatType())), ("pixel_spacing", T.ArrayType(T.FloatType())),
    ("slice_location", T.FloatType(), True), ("rows", _I), ("cols", _I), ("slope", _D), ("intercept", _D),
    ("pixels", T.ArrayType(_I)),
)
SCANS = _struct(("pid", _S), ("shape", T.ArrayType(_I)), ("spacing", T.ArrayType(_D)), ("origin", T.ArrayType(_D)))
VOXELS = _struct(("pid", _S), ("z", _I), ("y", _I), ("x", _I), ("v", _D))
LABELS_CSV = _struct(("id", _S, True), ("cancer", _I, True))
POINTS_CSV = _struct(("id", _S, True), ("x", _D, True), ("y", _D, True), ("z", _D, True), ("d", _D, True))
SUBMISSION_CSV = _struct(("id", _S, True), ("cancer", _D, True))

# The property columns of an annotation file, in file order after id, x, y, z.
PROPERTY_COLUMNS = [
    "diameter", "calcification", "internalStructure", "lobulation", "malignancy", "margin", "sphericity",
    "spiculation", "subtlety", "texture",
]
PROPERTIES_CSV = _struct(
    ("id", _S, True), ("x", _D, True), ("y", _D, True), ("z", _D, True), *[(p, _D, True) for p in PROPERTY_COLUMNS]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself, or an error naming what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df
