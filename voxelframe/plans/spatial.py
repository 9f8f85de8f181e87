"""Distance joins as equi joins on grid cells.

Each point gets the cell ``floor(coordinate / width)`` per axis. One side is repeated once for every
cell its search box touches; the other side keeps its single home cell. The shuffle key is
(group, cell), so a group that holds a large share of the rows spreads over its cells, and only
points in touching cells meet before the exact distance test. Cells are some times as wide as the reach:
a box as wide as a cell or wider touches 8 to 27 of them, and these copies are what a join of many points writes to disk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cell width over reach. A box then touches 3.4 cells on average in three dimensions, where 1 gives 27.
WIDTHS = 4.0


def home_cells(df: DataFrame, axes: Sequence[str], width: float) -> DataFrame:
    for i, c in enumerate(axes):
        df = df.withColumn(f"__cell{i}", F.floor(F.col(c) / F.lit(float(width))).cast("long"))
    return df


def search_cells(df: DataFrame, axes: Sequence[str], reach: Column, width: float, forward: bool = False) -> DataFrame:
    """One row per cell touched by the box [c - reach, c + reach]; with ``forward`` it begins at c on the first axis."""
    w = F.lit(float(width))
    for i, c in enumerate(axes):
        low = F.floor((F.col(c) if forward and i == 0 else F.col(c) - reach) / w).cast("long")
        high = F.floor((F.col(c) + reach) / w).cast("long")
        df = df.withColumn(f"__cell{i}", F.explode(F.sequence(low, high)))
    return df


def squared_distance(left: Sequence[str], right: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for a, b in zip(left, right):
        total = total + (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return total


def join_within(
    searching: DataFrame,
    resting: DataFrame,
    by: Sequence[str],
    searching_axes: Sequence[str],
    resting_axes: Sequence[str],
    reach: float | str | Column,
    condition: Column,
    width: float | None = None,
    forward: bool = False,
) -> DataFrame:
    """Inner join of points no further apart than ``reach`` per axis that satisfy ``condition``.

    ``reach`` is a number or a column of ``searching``; ``condition`` is the exact predicate.
    Apart from ``by`` the two sides must not share column names. ``forward``: the condition holds only where the resting
    point is not before the searching one on the first axis, so nothing is searched there.
    """
    if width is None:
        if not isinstance(reach, (int, float)):
            raise ValueError("a cell width is needed when the reach is a column")
        width = WIDTHS * float(reach)
    r = F.lit(float(reach)) if isinstance(reach, (int, float)) else (
        F.col(reach) if isinstance(reach, str) else reach
    )
    cells = [f"__cell{i}" for i in range(len(searching_axes))]
    a = search_cells(searching, searching_axes, r, width, forward)
    b = home_cells(resting, resting_axes, width)
    return a.join(b, [*by, *cells], "inner").filter(condition).drop(*cells)


def drop_when_near(
    resting: DataFrame,
    searching: DataFrame,
    by: Sequence[str],
    resting_axes: Sequence[str],
    searching_axes: Sequence[str],
    reach: float | Column,
    width: float,
    condition: Column,
    how: str = "left_anti",
) -> DataFrame:
    """Rows of ``resting`` without (or, for ``left_semi``, with) a near match; no pair is emitted."""
    r = F.lit(float(reach)) if isinstance(reach, (int, float)) else reach
    cells = [f"__cell{i}" for i in range(len(resting_axes))]
    keys = [*by, *cells]
    a = home_cells(resting, resting_axes, width)
    b = search_cells(searching, searching_axes, r, width)
    b = b.select([F.col(c).alias(f"__s_{c}") if c in keys else F.col(c) for c in b.columns])
    on = condition
    for k in keys:
        on = on & (a[k] == b[f"__s_{k}"])
    return a.join(b, on, how).drop(*cells)


def _level(reach: Column, width: float) -> Column:
    """The first grid, each of twice the width of the one before, whose cells are at least as wide as the search box."""
    return F.greatest(F.coalesce(F.ceil(F.log2(2 * reach / F.lit(float(width)))), F.lit(0)), F.lit(0)).cast("int")


#: Cells per axis of a block; rows are placed by blocks and repeated for cells only after the shuffle.
BLOCK = 8


def met_when_near_sized(
    resting: DataFrame,
    searching: DataFrame,
    by: str,
    key: str,
    resting_axes: Sequence[str],
    searching_axes: Sequence[str],
    reach: Column,
    least: Column,
    width: float,
    condition: Column,
) -> DataFrame:
    """(by, key) of ``resting`` rows (unique by them) with a near match, for search boxes of very different sizes.

    A searching point stands in the grid of its own size, in at most 8 cells of it; a resting one looks into
    one cell of each grid from that of ``least`` on, the smallest reach that can match it. ``width`` is that of the finest grid.
    Rows travel to blocks of cells of one grid, where few stand twice.
    """
    # the join's keys are blocks and cells, the rows are placed by blocks alone
    resting.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    at = [f"__cell{i}" for i in range(len(resting_axes))]
    b = searching.withColumn("__reach", reach).withColumn("__slevel", _level(F.col("__reach"), width))
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__slevel"))
    ends = {c: [F.floor((F.col(axis) + sign * F.col("__reach")) / size) for sign in (-1, 1)] for c, axis in zip(at, searching_axes)}
    for c, (low, high) in ends.items():
        b = b.withColumn(f"__sb{c}", F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))))
    b = b.withColumnRenamed(by, "__sby").repartition("__sby", "__slevel", *[f"__sb{c}" for c in at])
    for c, (low, high) in ends.items():
        first = F.col(f"__sb{c}") * BLOCK
        b = b.withColumn(f"__s{c}", F.explode(F.sequence(F.greatest(low, first), F.least(high, first + (BLOCK - 1)))))
    b = b.drop("__reach")
    top = searching.agg(F.max(_level(reach, width))).scalar()
    a = resting.withColumn("__level", F.explode(F.sequence(F.least(_level(least, width), top), top)))
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__level"))
    cells = {c: F.floor(F.col(axis) / size) for c, axis in zip(at, resting_axes)}
    a = a.withColumns({f"__b{c}": F.floor(cell / BLOCK) for c, cell in cells.items()}).repartition(by, "__level", *[f"__b{c}" for c in at])
    a = a.withColumns(cells)
    on = (F.col(by) == F.col("__sby")) & (F.col("__level") == F.col("__slevel")) & condition
    for c in at:
        on = on & (F.col(f"__b{c}") == F.col(f"__sb{c}")) & (F.col(c) == F.col(f"__s{c}"))
    return a.join(b, on, "left_semi").select(by, key).distinct()


def drop_when_near_sized(resting: DataFrame, searching: DataFrame, by: str, key: str, *args) -> DataFrame:
    """Rows of ``resting`` without a near match; arguments as of :func:`met_when_near_sized`."""
    return resting.join(met_when_near_sized(resting, searching, by, key, *args), [by, key], "left_anti")
