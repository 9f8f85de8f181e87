"""Aggregates over patients, annotations and voxels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.plans.ordered import attach, rank_within

# Default equalisation grid, equal target mass per bin, and heat-map geometry.
HIST_BINS = [float(b) for b in range(-950, 500, 100)]
HEATMAP_EXTENT = 400.0
HEATMAP_SIZE = 48
HEATMAP_NORM = 32.0


def as_lists(
    df: DataFrame, by: Sequence[str], order: Sequence[str], item: Column, bucket: Column,
    chunk: int = 1024,
) -> DataFrame:
    """Ordered lists per group, cut into chunks of at most ``chunk`` items.

    A list without bound cannot be one row; a group of any size becomes as many rows as it needs,
    numbered from 0, and concatenating them in order gives the list.
    """
    ranked = rank_within(
        df.withColumn("__item", item), by, [F.col(c) for c in order], bucket, "__i"
    ).withColumn("chunk", F.floor((F.col("__i") - 1) / F.lit(chunk)).cast("long"))
    return ranked.groupBy(*by, "chunk").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__i", "__item"))), lambda s: s["__item"]
        ).alias("items")
    )


def count_classes(annotations: DataFrame, diameter: str = "d", by: str = "pid") -> DataFrame:
    """Positives, negatives and patients in one row; two-level so that hot patients pre-aggregate."""
    per = annotations.groupBy(by).agg(
        F.count_if(F.col(diameter) > 0).alias("p"), F.count_if(F.col(diameter) == 0).alias("n")
    )
    return per.agg(
        F.sum("p").cast("long").alias("n_pos"), F.sum("n").cast("long").alias("n_neg"),
        F.count(F.lit(1)).alias("n_patients"),
    )


def class_ratio(labelled: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return labelled.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("ratio")
    )


def extrema(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Minimum and maximum of several columns, overall or per group."""
    out = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(*out)


def frequency(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values with their counts, most frequent first."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def mask_proportion(voxels: DataFrame, inside: Column) -> DataFrame:
    return voxels.agg(
        F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside")
    )


def mean_and_std(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


# --- histogram equalisation ------------------------------------------------------------------


def equalisation_borders(
    voxels: DataFrame,
    by: str = "pid",
    value: str = "hu",
    bins: Sequence[float] = tuple(HIST_BINS),
    mass: Sequence[float] | None = None,
) -> DataFrame:
    """Original-scale borders whose bins hold the target mass, one array per patient.

    Values are reduced to (value, count) first: HU are integers, so the exact percentile sees at
    most as many entries as there are HU levels, however large the scan.
    """
    n = len(bins) - 1
    mass = [1.0 / n] * n if mass is None else list(mass)
    at, total = [], 0.0
    for m in mass:
        at.append(min(total, 1.0))
        total += m
    levels = (
        voxels.filter((F.col(value) > bins[0]) & (F.col(value) < bins[-1]))
        .groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    )
    inner = F.percentile(F.col(value), at, F.col("__n"))
    return levels.groupBy(by).agg(F.concat(inner, F.array(F.lit(float(bins[-1])))).alias("borders"))


def equalise(
    value: Column, borders: Column, bins: Sequence[float] = tuple(HIST_BINS)
) -> Column:
    """Piecewise-linear map of [border i, border i+1) onto [bin i, bin i+1); other values stay."""
    out = None
    for i in range(len(bins) - 1):
        low, high = borders[i], borders[i + 1]
        width = F.lit(float(bins[i + 1] - bins[i]))
        scaled = F.try_divide(value - low, high - low) * width + F.lit(float(bins[i]))
        hit = (value >= low) & (value < high)
        out = F.when(hit, scaled) if out is None else out.when(hit, scaled)
    return out.otherwise(value.cast("double"))


def apply_equalisation(
    voxels: DataFrame, borders: DataFrame, by: str = "pid", value: str = "hu", out: str = "v",
    bins: Sequence[float] = tuple(HIST_BINS),
) -> DataFrame:
    """Equalise voxels with their patient's borders; patients without borders keep their values."""
    joined = voxels.join(borders.select(by, "borders"), by, "left")
    known = F.col("borders").isNotNull()
    mapped = F.when(known, equalise(F.col(value), F.col("borders"), bins))
    return joined.withColumn(out, F.coalesce(mapped, F.col(value).cast("double"))).drop("borders")


# --- candidates ------------------------------------------------------------------------------


def heat_map(
    candidates: DataFrame, value: str, spacing: Sequence[float], by: str = "pid",
    out_spacing: float = 1.0, extent: float = HEATMAP_EXTENT, size: int = HEATMAP_SIZE,
    norm: float = HEATMAP_NORM,
) -> DataFrame:
    """Weighted 3-D histogram of candidate positions."""
    cells = [
        F.floor(F.col(c) * F.lit(s) / F.lit(out_spacing) / F.lit(extent) * F.lit(size)).cast("int").alias(f"h{c}")
        for c, s in zip("zyx", spacing)
    ]
    return candidates.groupBy(by, *cells).agg((F.sum(value) / F.lit(norm)).alias("heat"))


def property_summary(pairs: DataFrame, by: Sequence[str], prop: str, u: Column) -> DataFrame:
    """Mean, median and one random pick of a property over the marks of a group."""
    return pairs.groupBy(*by).agg(
        F.avg(prop).alias("mean"), F.percentile(prop, 0.5).alias("median"),
        F.min_by(F.col(prop), u).alias("pick"),
    )


def objective_means(
    losses: DataFrame, objectives: Sequence[str], weights: dict[str, float] | None = None
) -> DataFrame:
    """Mean loss per objective over enabled rows (NULL = not enabled) and their weighted sum."""
    means = losses.agg(*[F.avg(o).alias(o) for o in objectives])
    total = F.lit(0.0)
    for o in objectives:
        total = total + F.coalesce(F.col(o), F.lit(0.0)) * F.lit(float((weights or {}).get(o, 1.0)))
    return means.withColumn("total", total)


def masked_mean(value: Column, enabled: Column) -> Column:
    """Mean where enabled, zero instead of an error when nothing is."""
    return F.sum(enabled * value) / (F.lit(1e-5) + F.sum(enabled))


def set_fingerprint(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Order-free digest of a set of ids.

    The ids are never brought together: four additive parts of each id's md5 are summed, so any
    number of rows combines on the map side, and the md5 of the sums is the fingerprint.
    """
    digest = F.md5(F.col(key).cast("string"))
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
        for i in range(4)
    ]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.md5(F.concat_ws("|", *parts)).alias("fingerprint")
    )


def share_of_total(df: DataFrame, by: Sequence[str], value: str, norm: float = 1.0, shift: bool = False, out: str = "share") -> DataFrame:
    """Value over the group's sum, after subtracting the group's minimum if asked.

    The totals are aggregated with map-side combine and joined back, so no group is windowed whole.
    """
    stats = df.groupBy(*by).agg(
        F.sum(value).alias("__sum"), F.min(value).alias("__min"), F.count(value).alias("__n")
    )
    base = F.col("__min") if shift else F.lit(0.0)
    total = F.col("__sum") - base * F.col("__n")
    return (
        attach(df, stats, list(by))
        .withColumn(out, F.try_divide(F.col(value) - base, total) * F.lit(float(norm)))
        .drop("__sum", "__min", "__n")
    )
