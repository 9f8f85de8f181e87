"""From slices to ordered scans.

Slices are numbered by range partitions of (patient, position, id) with carried last rows, so a series of any length is cut over
tasks like the rest; windows hold pairs of slices only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.plans.ordered import attach, rank_and_previous

TOLERANCE = 0.01


def order_slices(slices: DataFrame, position: str = "position_mm", by: str = "pid", sid: str = "sid") -> DataFrame:
    """Add ``slice_no`` (from 0) and ``gap`` to the previous slice along the position."""
    numbered = rank_and_previous(slices, [by], [position, sid], position, "__rank", "__previous")
    return numbered.withColumn("slice_no", (F.col("__rank") - 1).cast("int")).withColumn("gap", F.col(position) - F.col("__previous")).drop("__rank", "__previous")


def uniform_spacing(ordered: DataFrame, by: str = "pid", two_sided: bool = False) -> DataFrame:
    """Per patient: is no gap larger than the first one by the tolerance or more?"""
    first = ordered.groupBy(by).agg(
        F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("slice_no"))).alias("first_gap"),
        F.max("gap").alias("max_gap"),
        F.min("gap").alias("min_gap"),
        F.count(F.lit(1)).alias("n_slices"),
    )
    ok = F.col("max_gap") - F.col("first_gap") < TOLERANCE
    if two_sided:
        ok = ok & (F.col("min_gap") - F.col("first_gap") > -TOLERANCE)
    return first.select(by, "n_slices", "first_gap", F.coalesce(ok, F.lit(True)).alias("uniform"))


def assemble_scans(
    slices: DataFrame, position: str = "position_mm", by: str = "pid", sid: str = "sid",
    instance: str = "instance_number",
) -> DataFrame:
    """Ordered slices per patient, one series each.

    Patients whose spacing is not uniform are taken for doubled series: consecutive slices are
    paired, the larger instance number of a pair stays (the second on a tie), an odd last slice is
    dropped. ``resolved`` tells whether the spacing of the result is uniform.
    """
    ordered = order_slices(slices, position, by, sid)
    first = uniform_spacing(ordered, by).select(by, F.col("uniform").alias("__uniform"))
    tagged = attach(ordered, first, [by])
    single = tagged.filter("__uniform").drop("__uniform", "gap", "slice_no")
    doubled = tagged.filter("not __uniform")
    pair = Window.partitionBy(by, F.floor(F.col("slice_no") / 2))
    best = F.max(F.struct(F.col(instance), F.col("slice_no"))).over(pair)
    kept = (
        doubled.withColumn("__best", best).withColumn("__n", F.count(F.lit(1)).over(pair))
        .filter((F.col("__n") == 2) & (F.col("__best.slice_no") == F.col("slice_no")))
        .drop("__best", "__n", "__uniform", "gap", "slice_no")
    )
    again = order_slices(single.unionByName(kept), position, by, sid)
    verdict = uniform_spacing(again, by).select(by, F.col("first_gap").alias("spacing_z"), F.col("uniform").alias("resolved"))
    return attach(again, verdict, [by])


def principal_line(
    slices: DataFrame, x: str = "mx", y: str = "my", z: str = "mz", by: str = "pid", sid: str = "sid"
) -> DataFrame:
    """Position of each slice on the line through the two mid-points furthest apart; 0 if alone.

    Only points that can belong to the furthest pair are paired: with centre c, radius R and a pair
    already known at distance D0, both ends of a longer pair lie at least D0 - R from c. On a
    straight series that leaves the two ends. Ties go to the lowest pair of ids.
    """
    p = slices.select(by, sid, *[F.col(c).cast("double").alias(n) for n, c in zip("abc", (x, y, z))])

    def dist(left: str, right: str):
        return F.sqrt(sum(
            (F.col(f"{left}{n}") - F.col(f"{right}{n}")) ** 2 for n in "abc"
        ))

    box = p.groupBy(by).agg(
        *[((F.min(n) + F.max(n)) / 2).alias(f"m{n}") for n in "abc"], F.count(F.lit(1)).alias("n")
    )
    out = p.join(box, by).withColumn("r", dist("", "m"))
    far = out.groupBy(by).agg(F.max("r").alias("big_r"), F.max_by(F.struct("a", "b", "c"), F.struct("r", sid)).alias("f"))
    start = out.join(far, by).select(
        "*", *[F.col(f"f.{n}").alias(f"f{n}") for n in "abc"]
    ).withColumn("df", dist("", "f"))
    known = start.groupBy(by).agg(F.max("df").alias("d0"))
    ends = start.join(known, by).filter(F.col("r") >= (F.col("d0") - F.col("big_r")) * (1 - 1e-9))
    # copies of a point add nothing: the lowest ids stand for them
    ends = ends.groupBy(by, "a", "b", "c").agg(F.min(sid).alias(sid))
    left = ends.select(by, F.col(sid).alias("s1"), *[F.col(n).alias(f"p{n}") for n in "abc"])
    right = ends.select(by, F.col(sid).alias("s2"), *[F.col(n).alias(f"q{n}") for n in "abc"])
    pairs = left.join(right, by).filter("s1 < s2").withColumn("dist", dist("p", "q"))
    axis = pairs.groupBy(by).agg(
        F.min_by(
            F.struct("dist", *[f"p{n}" for n in "abc"], *[f"q{n}" for n in "abc"]),
            F.struct((-F.col("dist")).alias("k"), "s1", "s2"),
        ).alias("axis")
    )
    dot = F.lit(0.0)
    for n in "abc":
        unit = (F.col(f"axis.q{n}") - F.col(f"axis.p{n}")) / F.col("axis.dist")
        dot = dot + unit * (F.col(n) - F.col(f"axis.p{n}"))
    placed = p.join(axis, by, "left")
    return placed.select(by, sid, F.coalesce(dot, F.lit(0.0)).alias("line_pos"))


def thickness_check(
    slices: DataFrame, line: DataFrame, position: str = "position_mm", location: str = "slice_location",
    by: str = "pid", sid: str = "sid",
) -> DataFrame:
    """Slice thickness three ways: first gap by position, by slice location (0 when missing), and
    the number of different gaps along the principal line (to six places) with the largest."""
    ordered = order_slices(slices, position, by, sid).filter("slice_no < 2")
    first = ordered.groupBy(by).agg(
        F.abs(F.max(F.when(F.col("slice_no") == 1, F.col("gap")))).alias("by_position"),
        F.coalesce(
            F.abs(
                F.max(F.when(F.col("slice_no") == 1, F.col(location)))
                - F.max(F.when(F.col("slice_no") == 0, F.col(location)))
            ),
            F.lit(0.0),
        ).alias("by_location"),
    )
    different = order_slices(line, "line_pos", by, sid).select(by, F.round("gap", 6).alias("gap")).distinct()
    gaps = different.groupBy(by).agg(F.count("gap").alias("n_gaps"), F.max("gap").alias("max_gap"))
    return first.join(gaps, by)
