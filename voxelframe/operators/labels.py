"""Training targets for annotations and patients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.scalars import diameter_to_prob, digitize, size_bin
from voxelframe.operators.joins import AXES, marks_within

NODULE_MIN = 0.01


def nodule_label(d: str = "d") -> Column:
    return (F.col(d) > 0).cast("int")


def soft_malignancy(d: str = "d") -> Column:
    return F.when(F.col(d) > 0, diameter_to_prob(d)).otherwise(F.lit(0.0))


def size_label(d: str = "d") -> Column:
    return F.when(F.col(d) > 0, F.col(d)).otherwise(F.lit(0.0))


def size_bin_label(borders: Sequence[float], d: str = "d", overflow: str = "last") -> Column:
    return size_bin(d, borders, overflow)


def property_targets(
    annotations: DataFrame,
    marks: DataFrame,
    objectives: Sequence[str],
    bin_borders: dict[str, Sequence[float]],
    kinds: dict[str, str],
    by: str = "pid",
    aid: str = "aid",
    d: str = "d",
    radius: float = 5.0,
    mark_axes: Sequence[str] = ("cz", "cy", "cx"),
) -> DataFrame:
    """Target value and enable flag per objective, in order, as two arrays.

    ``nodule`` is always set. Nodules also get ``size`` (digitised when it has borders) and, from the
    reader marks within the radius, each property: the digitised median when it has borders, else
    the mean, mapped to (v - 1) / 4 if bounded and to v - 1 otherwise. What is unknown is 0 and
    disabled.
    """
    props = [o for o in objectives if o not in ("nodule", "size")]
    left = annotations.select(by, aid, *AXES, d)
    out = left
    if props:
        # equal marks travel once with their number, and annotations at one place are looked up once
        packs = marks.groupBy(by, *mark_axes, *props).agg(F.count(F.lit(1)).alias("__w"))
        places = left.filter(F.col(d) > NODULE_MIN).select(by, *AXES).distinct()
        weight = F.col("__w")
        aggs = [
            F.percentile(p, 0.5, weight).alias(f"__{p}") if p in bin_borders
            else (F.sum(F.col(p) * weight) / F.sum(weight)).alias(f"__{p}")
            for p in props
        ]
        near = marks_within(places, packs, radius, by, mark_axes)
        found = near.groupBy(by, *AXES).agg(*aggs, F.lit(True).alias("__found"))
        out = left.join(found, [by, *AXES], "left")
        for p in props:
            # a negative at the place of a nodule stays without properties
            out = out.withColumn(f"__{p}", F.when(F.col(d) > NODULE_MIN, F.col(f"__{p}")))
    nodule = F.col(d) > NODULE_MIN
    values = []
    for o in objectives:
        if o == "nodule":
            values.append(nodule.cast("double"))
        elif o == "size":
            size = digitize(d, bin_borders["size"]).cast("double") if "size" in bin_borders else F.col(d)
            values.append(F.when(nodule, size))
        elif o in bin_borders:
            found = F.col(f"__{o}").isNotNull()
            values.append(F.when(found, digitize(f"__{o}", bin_borders[o]).cast("double")))
        elif kinds[o] == "bounded_continuous":
            values.append((F.col(f"__{o}") - 1) / 4)
        else:
            values.append(F.col(f"__{o}") - 1)
    return out.select(
        by, aid,
        F.array(*[F.coalesce(v, F.lit(0.0)) for v in values]).alias("target"),
        F.array(*[v.isNotNull().cast("double") for v in values]).alias("enabled"),
    )


def property_vector(props: Column, chosen: Sequence[str], everything: Sequence[str], d: Column) -> Column:
    """Chosen properties over 5, or all raw when none is chosen; zeros for negatives."""
    names = list(chosen) or list(everything)
    values = [F.element_at(props, p) / F.lit(5.0) if chosen else F.element_at(props, p) for p in names]
    return F.when(d == 0, F.array(*[F.lit(0.0)] * len(names))).otherwise(F.array(*values))
