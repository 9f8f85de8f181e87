"""Joins between patients, labels, candidates, annotations, masks and voxels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.plans.ordered import forward_fill, value_bucket
from voxelframe.plans.spatial import drop_when_near, join_within, squared_distance

AXES = ("z", "y", "x")


def keep_known(df: DataFrame, known: DataFrame, key: str = "pid") -> DataFrame:
    """Rows whose key occurs on the other side."""
    return df.join(known.select(key), key, "left_semi")


def exclude_done(df: DataFrame, done: DataFrame, key: str = "pid") -> DataFrame:
    """Rows whose key was not produced before; keys are compared as a whole."""
    return df.join(done.select(key), key, "left_anti")


def attach_label(df: DataFrame, labels: DataFrame, key: str = "pid", label: str = "label") -> DataFrame:
    """Label of each row, NULL when unknown. Label keys must be unique."""
    return df.join(labels.select(key, label), key, "left")


def right_wins(left: DataFrame, right: DataFrame, key: str = "pid", label: str = "label") -> DataFrame:
    """Union of two keyed tables in which the right side overrides the left."""
    a = left.select(key, F.col(label).alias("__l"))
    b = right.select(key, F.col(label).alias("__r"), F.lit(True).alias("__in_r"))
    out = F.when(F.col("__in_r"), F.col("__r")).otherwise(F.col("__l"))
    return a.join(b, key, "full_outer").select(key, out.alias(label))


def positives_and_negatives(
    patients: DataFrame, positives: DataFrame, negatives: DataFrame, key: str = "pid"
) -> DataFrame:
    """Counts of both kinds per patient and the class of the patient.

    ``positive``: has positives (both lists are used); ``negative``: has negatives only; ``none``:
    neither, to be reported.
    """
    p = positives.groupBy(key).agg(F.count(F.lit(1)).alias("n_pos"))
    n = negatives.groupBy(key).agg(F.count(F.lit(1)).alias("n_neg"))
    both = p.join(n, key, "full_outer")
    kind = (
        F.when(F.col("n_pos") > 0, "positive").when(F.col("n_neg") > 0, "negative").otherwise("none")
    )
    return (
        patients.select(key).distinct().join(both, key, "left")
        .fillna(0, ["n_pos", "n_neg"]).withColumn("kind", kind)
    )


def match_nearest(
    annotations: DataFrame,
    blobs: DataFrame,
    by: str = "pid",
    aid: str = "aid",
    cid: str = "cid",
    diameter: str = "d",
    width: float = 16.0,
) -> DataFrame:
    """Nearest blob of each annotation when it lies within the annotation's radius.

    A hit needs distance <= d/2, so the nearest blob only matters inside that reach: a cell join
    finds it exactly without comparing an annotation with every blob of the patient. Blobs at one
    position are reduced to the lowest id first, which is also the tie rule, and annotations equal in
    place and size are matched once, so heaps of copies do not multiply. Annotations without a hit
    have no row.
    """
    places = blobs.groupBy(
        by, *[F.col(c).alias(f"__b{c}") for c in AXES]
    ).agg(F.min(cid).alias(cid))
    keys = [by, *AXES, diameter]
    marks = annotations.select(*keys).distinct().withColumn("__r", F.col(diameter) / 2.0)
    dist2 = squared_distance(AXES, [f"__b{c}" for c in AXES])
    pairs = join_within(
        marks, places, [by], AXES, [f"__b{c}" for c in AXES], "__r",
        dist2 <= F.col("__r") * F.col("__r"), width,
    )
    best = F.min(F.struct(dist2.alias("dist2"), F.col(cid).alias(cid)))
    nearest = pairs.groupBy(*keys).agg(best.alias("__best"))
    return annotations.select(by, aid, *AXES, diameter).join(nearest, keys).select(by, aid, f"__best.{cid}", "__best.dist2")


def flag_claimed(blobs: DataFrame, matches: DataFrame, by: str = "pid", cid: str = "cid") -> DataFrame:
    """Add ``flag`` = 1 for blobs that are the match of some annotation."""
    claimed = matches.select(by, cid).distinct().withColumn("flag", F.lit(1))
    return blobs.join(claimed, [by, cid], "left").fillna(0, ["flag"])


def marks_within(
    annotations: DataFrame,
    marks: DataFrame,
    radius: float = 5.0,
    by: str = "pid",
    mark_axes: Sequence[str] = ("cz", "cy", "cx"),
) -> DataFrame:
    """Reader marks strictly closer than the radius to each annotation, one row per pair.

    Marks without a centroid are dropped. ``marks`` may share no column with ``annotations`` but
    ``by``.
    """
    located = marks
    for c in mark_axes:
        located = located.filter(F.col(c).isNotNull())
    near = squared_distance(AXES, mark_axes) < F.lit(radius * radius)
    return join_within(annotations, located, [by], AXES, mark_axes, radius, near)


def point_in_mask(points: DataFrame, mask: DataFrame, by: str = "pid") -> DataFrame:
    """Add ``inside``: is the voxel the point truncates to set in the sparse mask?"""
    keys = [by, *[f"__i{c}" for c in AXES]]
    cells = mask.select(
        F.col(by), *[F.col(c).cast("int").alias(f"__i{c}") for c in AXES], F.lit(True).alias("__hit")
    )
    out = points
    for c in AXES:
        out = out.withColumn(f"__i{c}", F.col(c).cast("int"))
    return (
        out.join(cells, keys, "left")
        .withColumn("inside", F.coalesce("__hit", F.lit(False)))
        .drop("__hit", *keys[1:])
    )


def close_pairs(
    blobs: DataFrame, distance: float, by: str = "pid", cid: str = "cid", width: float | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Pairs (lower id, higher id) of blobs no further apart than the distance.

    ``keep`` names columns to carry along, of both blobs: ``i_<name>`` and ``j_<name>``. The blob that comes first on the first axis
    searches, so each pair is found once and no blob looks back.
    """
    axes = [f"__b{c}" for c in AXES]
    left = blobs.select(by, F.col(cid).alias("__i"), *AXES, *[F.col(c).alias(f"__i_{c}") for c in keep])
    right = blobs.select(
        by, F.col(cid).alias("__j"), *[F.col(c).alias(b) for c, b in zip(AXES, axes)], *[F.col(c).alias(f"__j_{c}") for c in keep]
    )
    d2 = squared_distance(AXES, axes)
    level = (F.col(AXES[0]) == F.col(axes[0])) & (F.col("__i") < F.col("__j"))
    first = (F.col(AXES[0]) < F.col(axes[0])) & (F.col("__i") != F.col("__j")) | level
    near = first & (d2 <= F.lit(float(distance) ** 2))
    pairs = join_within(left, right, [by], AXES, axes, float(distance), near, width, forward=True)
    turned = F.col("__i") > F.col("__j")

    def both(a: str, b: str, i: str, j: str) -> list[Column]:
        return [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(i), F.when(turned, F.col(a)).otherwise(F.col(b)).alias(j)]

    kept = [x for c in keep for x in both(f"__i_{c}", f"__j_{c}", f"i_{c}", f"j_{c}")]
    return pairs.select(by, *both("__i", "__j", "i", "j"), F.sqrt(d2).alias("dist"), *kept)


def close_pair_counts(
    blobs: DataFrame, distance: float, by: str = "pid", width: float | None = None
) -> DataFrame:
    """Number of close pairs per group, without emitting pairs of copies.

    Blobs at one position are merged to a weight first, so a heap of copies costs one row; the
    weights give back the full count.
    """
    heaps = blobs.groupBy(by, *AXES).agg(F.count(F.lit(1)).alias("w"))
    left = heaps.select(by, *AXES, "w")
    right = heaps.select(by, *[F.col(c).alias(f"__b{c}") for c in AXES], F.col("w").alias("__bw"))
    axes = [f"__b{c}" for c in AXES]
    before = F.struct(*AXES) < F.struct(*axes)
    near = before & (squared_distance(AXES, axes) <= F.lit(float(distance) ** 2))
    across = (
        join_within(left, right, [by], AXES, axes, float(distance), near, width, forward=True)
        .groupBy(by).agg(F.sum(F.col("w") * F.col("__bw")).alias("n"))
    )
    within = heaps.filter("w > 1").groupBy(by).agg(F.sum(F.expr("w * (w - 1) div 2")).alias("n"))
    return across.unionByName(within).groupBy(by).agg(F.sum("n").cast("long").alias("n_pairs"))


#: Bricks per axis of a block.
BLOCK = 4


def patch_voxels(
    candidates: DataFrame,
    voxels: DataFrame,
    half: int,
    by: str = "pid",
    cid: str = "cid",
    value: str = "v",
    brick: int = 32,
) -> DataFrame:
    """Present voxels inside [c - half, c + half) of each candidate, with patch coordinates.

    Voxels stay single and carry a brick id; each candidate is repeated for the few bricks its
    window touches, so the large side is shuffled once at most. Both travel to blocks of bricks, and candidates
    are repeated for bricks only there.
    """
    # the join's keys are blocks and bricks, the rows are placed by blocks alone
    voxels.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    c = candidates.select(by, cid, *[F.bround(F.col(a)).cast("int").alias(f"__c{a}") for a in AXES])
    v = voxels.select(by, *AXES, value)
    blocks, bricks = [f"__block{i}" for i in range(3)], [f"__brick{i}" for i in range(3)]
    ends = [[F.floor((F.col(f"__c{a}") + d) / F.lit(brick)).cast("int") for d in (-half, half - 1)] for a in AXES]
    for block, (low, high) in zip(blocks, ends):
        c = c.withColumn(block, F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))))
    v = v.withColumns({block: F.floor(F.floor(F.col(a) / F.lit(brick)) / BLOCK) for block, a in zip(blocks, AXES)})
    c, v = c.repartition(by, *blocks), v.repartition(by, *blocks)
    for block, name, (low, high) in zip(blocks, bricks, ends):
        first = (F.col(block) * BLOCK).cast("int")
        c = c.withColumn(name, F.explode(F.sequence(F.greatest(low, first), F.least(high, first + (BLOCK - 1)))))
    v = v.withColumns({name: F.floor(F.col(a) / F.lit(brick)).cast("int") for name, a in zip(bricks, AXES)})
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(a) >= F.col(f"__c{a}") - half) & (F.col(a) < F.col(f"__c{a}") + half)
    joined = v.join(c, [by, *blocks, *bricks]).filter(inside)
    return joined.select(
        by, cid, *[(F.col(a) - F.col(f"__c{a}") + half).cast("int").alias(f"p{a}") for a in AXES], value
    )


def patch_dense(
    candidates: DataFrame, found: DataFrame, size: int, by: str = "pid", cid: str = "cid", value: str = "v"
) -> DataFrame:
    """The full patch grid of each candidate with zeros where no voxel was found."""
    grid = candidates.select(by, cid)
    for a in AXES:
        grid = grid.withColumn(f"p{a}", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    keys = [by, cid, "pz", "py", "px"]
    return grid.join(found, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0).cast("double")))


def step_value(index: Column | str, schedule: dict[int, float]) -> Column:
    """Value of the largest schedule key at or below the index; key 0 is the base.

    For schedules written by hand: the steps become one expression, nothing is joined.
    """
    index = F.col(index) if isinstance(index, str) else index
    out = F.lit(float(schedule[0]))
    for start in sorted(schedule):
        out = F.when(index >= start, F.lit(float(schedule[start]))).otherwise(out)
    return out


def asof_lookup(
    df: DataFrame, steps: DataFrame, by: Sequence[str], index: str, value: str, width: float
) -> DataFrame:
    """Latest step at or before each row of ``df``, for step tables of any size.

    ``steps`` has the ``by`` and ``index`` columns and one ``value`` column. Both sides are stacked
    and the value is filled forward in slots of ``width`` index units, so no group is sorted whole.
    A step at the same index as a row counts.
    """
    left = df.withColumn("__step", F.lit(1)).withColumn(value, F.lit(None).cast(steps.schema[value].dataType))
    right = steps.select(*by, index, value, F.lit(0).alias("__step"))
    stacked = left.unionByName(right, allowMissingColumns=True)
    filled = forward_fill(
        stacked, by, [index, "__step"], value, value_bucket(F.col(index), width), "__value"
    )
    return (
        filled.filter("__step = 1").drop(value, "__step").withColumnRenamed("__value", value)
    )


def require_same_keys(
    predictions: DataFrame, labels: DataFrame, key: str = "pid", per: Sequence[str] = ()
) -> DataFrame:
    """Inner join that fails the job unless every group of predictions holds every label once.

    ``per`` names the columns of a group (such as the configuration). A key on one side only, a key
    repeated on either side, or a group that lacks a key raises.
    """
    per = list(per)
    y = labels.groupBy(key).agg(
        *[F.first(c).alias(c) for c in labels.columns if c != key], F.count(F.lit(1)).alias("__y")
    )
    p = predictions.withColumn("__p", F.lit(1))
    joined = p.join(y, key, "full_outer")
    one_sided = F.col("__p").isNull() | F.col("__y").isNull()
    message = F.concat(
        F.when(one_sided, F.lit("key on one side only: ")).otherwise(F.lit("repeated label: ")),
        F.coalesce(F.col(key).cast("string"), F.lit("NULL")),
    )
    guard = F.when(one_sided | (F.col("__y") > 1), F.raise_error(message).cast("int")).otherwise(F.lit(1))
    sound = joined.filter(guard == 1).drop("__p", "__y")
    once = sound.groupBy(*per, key).agg(F.count(F.lit(1)).alias("__n"))
    sizes = once.groupBy(*per).agg(F.max("__n").alias("__most"), F.count(F.lit(1)).alias("__keys"))
    n_labels = labels.agg(F.count(F.lit(1))).scalar()
    wrong = (F.col("__most") > 1) | (F.col("__keys") != n_labels)
    where = F.concat_ws(", ", *[F.col(c).cast("string") for c in per]) if per else F.lit("all")
    checked = sizes.filter(
        F.when(wrong, F.raise_error(F.concat(F.lit("missing or repeated keys: "), where)).cast("int"))
        .otherwise(F.lit(1)) == 1
    )
    if not per:
        return sound.filter(checked.agg(F.count(F.lit(1))).scalar() == 1)
    return sound.join(checked.select(*per), per, "left_semi")


def key_difference(left: DataFrame, right: DataFrame, key: str = "pid") -> DataFrame:
    """Sizes of both key sets and of their one-sided parts, one row."""
    a = left.select(key).distinct().withColumn("__a", F.lit(1))
    b = right.select(key).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count("__a").alias("n_left"),
        F.count("__b").alias("n_right"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"),
        F.count_if(F.col("__b").isNull()).alias("n_left_only"),
        F.count_if(F.col("__a").isNull()).alias("n_right_only"),
    ).withColumn("equal", (F.col("n_left_only") == 0) & (F.col("n_right_only") == 0))


def replicate(df: DataFrame, n: int, out: str = "replica") -> DataFrame:
    """Each row ``n`` times with its replica number."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
