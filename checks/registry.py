"""Named queries: a Spark callable and, where possible, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import lenses
from voxelframe.session import sound_unions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Data:
    """The test tables of one folder and the lenses over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("f_"):
            return lenses.spark_lens(self, name)
        if name in lenses.TABLES:
            return self.table(name)
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register a function of ``Data``; ``sql`` may use lens names as tables."""

    def wrap(fn: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Data(sound_unions(spark), folder))
        if sql is not None:
            SQL[name] = lenses.with_lenses(sql)
        return fn

    return wrap


def r6(c: Column | str) -> Column:
    """Six decimals, never minus zero: the form in which both engines compare doubles."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def R(expr: str) -> str:
    """SQL twin of :func:`r6`."""
    return f"(round(cast({expr} as double), 6) + 0e0)"


def tied6(c: Column) -> Column:
    """:func:`r6` for sums whose exact value may end in a 5 at the seventh decimal: noise of the order of summing must not decide."""
    return F.round(c.cast("decimal(38,9)"), 6).cast("double") + F.lit(0.0)


def T6(expr: str) -> str:
    """SQL twin of :func:`tied6`."""
    return f"(cast(round(cast({expr} as decimal(38,9)), 6) as double) + 0e0)"


U = lenses.duck_uniform
