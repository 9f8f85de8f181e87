"""Tile enumeration as a Python table function, next to the built-in ``explode`` form of
:func:`voxelframe.operators.volume.tile`, which is the default."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

OUT = StructType([StructField("tile", IntegerType()), StructField("local", IntegerType())])


class TilesOf:
    """Tiles of one axis that contain a coordinate."""

    def eval(self, at: int, size: int, window: int, stride: int):
        last = (size - window) // stride
        for tile in range(max(0, -(-(at - window + 1) // stride)), min(last, at // stride) + 1):
            yield tile, at - tile * stride


def register(spark, name: str = "tiles_of") -> None:
    spark.udtf.register(name, UserDefinedTableFunction(TilesOf, OUT))
