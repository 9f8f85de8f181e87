"""Bag union, difference and overlap of keyed sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from voxelframe.operators.joins import key_difference


def concatenate(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def difference(everything: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``everything`` whose key is not taken; duplicates stay."""
    return everything.join(taken.select(*keys), list(keys), "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Size of the intersection and whether the sets are equal."""
    return key_difference(left, right, key).select("n_both", "equal")
