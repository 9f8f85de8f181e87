"""Training and inference row sets: the data jobs a model is fed from.

Each job returns rows (patients, patch centres, targets), not tensors; patches follow by passing the
centres to :func:`patches`. Everything is a composition of the operators, seeded by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.scalars import HeadLayout, hu_norm, hu_norm_array, scale_patch_location
from voxelframe.operators import aggregates as AG
from voxelframe.operators import joins as J
from voxelframe.operators import labels as L
from voxelframe.operators import ranking as RK
from voxelframe.operators import sampling as SM
from voxelframe.operators import slices as SL
from voxelframe.operators import volume as V
from voxelframe.session import cut

AXES = ("z", "y", "x")


def centres(chosen: DataFrame, annotations: DataFrame, by: str = "pid", aid: str = "aid") -> DataFrame:
    """Positions and diameters of chosen (patient, annotation) rows."""
    return chosen.join(annotations.select(by, aid, *AXES, "d"), [by, aid])


def patches(
    centre_rows: DataFrame, voxels: DataFrame, shapes: DataFrame, spacing: Sequence[float], patch: Sequence[int],
    patch_mm: Sequence[float], cid: str = "aid", value: str = "hu", by: str = "pid", order: int = 1,
    normalise: Callable[[Column], Column] = hu_norm, **augment,
) -> DataFrame:
    """(pid, cid, pz, py, px, v): resampled patches with normalised intensities."""
    out = V.extract_patches(
        centre_rows.select(by, cid, *AXES).distinct(), voxels, shapes, spacing, patch, patch_mm, cid, value, by, order, **augment
    )
    return out.select(by, cid, "pz", "py", "px", normalise(F.col(value)).alias("v"))


def patch_pieces(
    centre_rows: DataFrame, voxels: DataFrame, shapes: DataFrame, spacing: Sequence[float], patch: Sequence[int],
    patch_mm: Sequence[float], cid: str = "aid", value: str = "hu", by: str = "pid", order: int = 1,
    normalise: Callable[[Column], Column] = hu_norm, **augment,
) -> DataFrame:
    """(pid, cid, places, v): the same patches in pieces, as arrays."""
    # the usual norm is taken array by array; others are expressions, which an array takes value by value
    change = hu_norm_array if normalise is hu_norm else None
    out = V.patch_pieces(
        centre_rows.select(by, cid, *AXES).distinct(), voxels, shapes, spacing, patch, patch_mm, cid, value, by, order, change, **augment
    )
    return out.select(by, cid, "places", F.col(value).alias("v") if change else F.transform(value, lambda v: normalise(v)).alias("v"))


def segmentation_patches(annotations: DataFrame, batch: int, seed: str, by: str = "pid", aid: str = "aid") -> DataFrame:
    """One random positive annotation per patient that has any, shuffled into batches."""
    pos = annotations.filter(F.col("d") > 0)
    one = SM.one_per_group(pos, seed, by, aid)
    return centres(SM.epoch_batches(one, batch, seed, by), pos, by, aid)


def segmentation_target(annotations: DataFrame, shape: Sequence[int | Column], kind: str = "sphere", by: str = "pid") -> DataFrame:
    """Voxels of the union of the annotations' shapes."""
    return V.rasterise_union(annotations.filter(F.col("d") > 0), shape, kind, by=by)


def candidate_batches(
    annotations: DataFrame, batch: int, share: float, seed: str, target: Column | None = None, by: str = "pid", aid: str = "aid"
) -> DataFrame:
    """Patients in batches with a fixed share of positive slots and a target (default: nodule or not)."""
    rows = centres(SM.positive_share_batches(annotations, batch, share, seed, by, aid), annotations, by, aid)
    return rows.withColumn("y", L.nodule_label() if target is None else target)


def candidate_validation(annotations: DataFrame, seed: str, target: Column | None = None, by: str = "pid", aid: str = "aid") -> DataFrame:
    """All positives with as many matched negatives, and the target."""
    rows = SM.matched_negatives(annotations.select(by, aid, *AXES, "d"), seed, by, aid)
    return rows.withColumn("y", L.nodule_label() if target is None else target)


def property_batches(
    annotations: DataFrame, marks: DataFrame, batch: int, share: float, seed: str, objectives: Sequence[str],
    bin_borders: dict[str, Sequence[float]], kinds: dict[str, str], by: str = "pid", aid: str = "aid",
) -> DataFrame:
    """Two-pool batches with property targets and their enable flags."""
    # the targets read the chosen rows several times
    chosen = cut(SM.two_pool_batches(annotations, batch, share, seed, by, aid, keep=(*AXES, "d")))
    targets = L.property_targets(chosen, marks, objectives, bin_borders, kinds, by, aid)
    return chosen.join(targets, [by, aid])


def property_epoch(annotations: DataFrame, share: float, batch: int, seed: str, by: str = "pid", aid: str = "aid") -> DataFrame:
    """All positives and negatives drawn with replacement at the wanted share, shuffled into batches."""
    epoch = SM.fixed_ratio_epoch(annotations, share, seed, by, aid).withColumn("draw", F.coalesce("draw", F.lit(-1)))
    rows = SM.shuffle_rank(epoch, seed + "-order", [by, aid, "draw"], out="__r")
    return rows.withColumn("batch_id", F.floor((F.col("__r") - 1) / batch).cast("long")).drop("__r")


def scans(
    slices: DataFrame, pixels: DataFrame, done: DataFrame | None = None, only: DataFrame | None = None,
    by: str = "pid", sid: str = "sid",
) -> DataFrame:
    """Voxels of the scans still to do: one ordered series per patient, slices numbered as z.

    ``slices`` holds position_mm and instance_number per slice, ``pixels`` (pid, sid, y, x, hu).
    """
    if done is not None:
        slices = J.exclude_done(slices, done, by)
    if only is not None:
        slices = J.keep_known(slices, only, by)
    ordered = SL.assemble_scans(slices, by=by, sid=sid)
    return pixels.join(ordered.select(by, sid, F.col("slice_no").cast("int").alias("z")), [by, sid]).select(by, *AXES, "hu")


def spacing_extrema(slices: DataFrame, by: str = "pid") -> DataFrame:
    """Smallest and largest slice distance and pixel spacing over all patients."""
    ordered = SL.assemble_scans(slices, by=by)
    per = ordered.groupBy(by).agg(F.max("spacing_z").alias("sz"), F.max("s_xy").alias("sy"))
    return AG.extrema(per, ["sz", "sy"])


def patient_slots(
    candidates: DataFrame, patients: DataFrame, labels: DataFrame, n: int, seed: str, threshold: float | None = None,
    shuffle: bool = False, score: str = "p", by: str = "pid", cid: str = "cid",
) -> DataFrame:
    """Exactly n candidate slots per known patient with scaled positions and the patient's label.

    Slots without a candidate, or with a score under the threshold, are empty (NULL). With ``shuffle``
    the first n candidates stand in random order.
    """
    known = J.keep_known(patients.select(by).distinct(), candidates, by)
    if shuffle:
        ranked = SM.shuffled_top(candidates, n, seed, score, by, cid).drop("rank").withColumnRenamed("slot", "rank")
        slots = known.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(n)))).join(ranked, [by, "rank"], "left")
    else:
        slots = RK.top_n_padded(candidates, known, n, score, by, cid)
    if threshold is not None:
        live = F.col(score) >= F.lit(float(threshold))
        slots = slots.withColumns({c: F.when(live, F.col(c)) for c in (cid, *AXES, score)})
    slots = slots.withColumns({f"loc_{c}": scale_patch_location(c) for c in AXES})
    return J.attach_label(slots, labels, by)


def random_negative_slots(
    candidates: DataFrame, labels: DataFrame, n: int, pool: int, seed: str, score: str = "p", by: str = "pid", cid: str = "cid"
) -> DataFrame:
    """First n of positive patients, n random of the first ``pool`` for the others."""
    return SM.label_dependent_pick(candidates, labels, n, pool, seed, score, by, cid)


def balanced_slots(
    candidates: DataFrame, labels: DataFrame, n: int, seed: str, score: str = "p", by: str = "pid", cid: str = "cid"
) -> DataFrame:
    """The balanced patient stream with each patient's first n candidates."""
    stream = SM.balanced_stream(J.keep_known(labels, candidates, by), seed, by)
    return stream.join(RK.top_n(candidates, n, score, by, cid), by)


def heat_maps(
    features: DataFrame, labels: DataFrame, layout: HeadLayout, spacing: Sequence[float], by: str = "pid"
) -> DataFrame:
    """Heat maps of malignancy with the patient's label."""
    valued = features.withColumn("__v", RK.by_bounded_malignancy(layout, "features"))
    return J.attach_label(AG.heat_map(valued, "__v", spacing, by), labels, by)


def replica_patches(candidates: DataFrame, n: int, ranges: dict[str, tuple[float, float]], seed: str, by: str = "pid", cid: str = "cid") -> DataFrame:
    """Each candidate n times with its own augmentation draw."""
    replicas = J.replicate(candidates, n)
    return replicas.select("*", *SM.augmentation(ranges, seed, by, cid, "replica"))


def masked_scan(
    voxels: DataFrame, mask: DataFrame, shapes: DataFrame, spacing: Sequence[float], patch: Sequence[int],
    patch_mm: Sequence[float], value: str = "hu", by: str = "pid",
) -> DataFrame:
    """Scan and lung mask resampled to one grid: (pid, z, y, x, value, inside)."""
    x = V.transform_scan(voxels, shapes, spacing, patch, patch_mm, value, by)
    m = V.transform_mask(mask, shapes, spacing, patch, patch_mm, by=by).withColumn("inside", F.lit(True))
    return x.join(m, [by, *AXES], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
