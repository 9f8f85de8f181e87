"""Seeded sampling, splits and batches.

Every draw is a hash of (seed, key): it does not depend on row order or partitioning, and a lost
task recomputes the same sample. Orders come from :func:`rank_within`, cut by the uniform itself,
whose equal slices hold equal shares of the rows; a class with any share of the data ranks in
parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.hashing import uniform, uniform_between
from voxelframe.operators.ranking import top_n
from voxelframe.plans.ordered import bucket_count, hash_bucket, rank_within
from voxelframe.session import cut


def shuffle_rank(
    df: DataFrame, seed: str, keys: Sequence[str], by: Sequence[str] = (), out: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """Random order per group (or overall), from 1. The number of ``buckets`` follows the table's size."""
    drawn = df.withColumn("__u", uniform(seed, *keys))
    order = [F.asc("__u"), *[F.asc(k) for k in keys]]
    return rank_within(drawn, by, order, hash_bucket(F.col("__u"), buckets or bucket_count(df)), out).drop("__u")


def stratified_holdout(df: DataFrame, share: float, seed: str, key: str = "pid", label: str = "label") -> DataFrame:
    """Mark per class round-half-even(share * n) rows as ``test``, the others as ``train``."""
    ranked = shuffle_rank(df, seed, [key], [label])
    sizes = df.groupBy(label).agg(F.bround(F.lit(share) * F.count(F.lit(1))).alias("__take"))
    split = F.when(F.col("rank") <= F.col("__take"), "test").otherwise("train")
    return ranked.join(sizes, label).withColumn("split", split).drop("rank", "__take")


def holdout(df: DataFrame, share: float, seed: str, key: str = "pid") -> DataFrame:
    """Mark floor(share * n) rows as ``valid``, the others as ``train``."""
    take = F.floor(F.lit(float(share)) * df.agg(F.count(F.lit(1))).scalar())
    ranked = shuffle_rank(df, seed, [key])
    return ranked.withColumn("split", F.when(F.col("rank") <= take, "valid").otherwise("train")).drop("rank")


def shards(df: DataFrame, n: int, order: Sequence[str], bucket: Column | None = None, out: str = "shard") -> DataFrame:
    """Contiguous shards 1..n of floor(rows / n) each; the last takes the rest. Without a bucket the order is cut by range."""
    size = F.floor(df.agg(F.count(F.lit(1))).scalar() / F.lit(n))
    ranked = rank_within(df, [], [F.asc(c) for c in order], bucket, "__r")
    # with fewer rows than shards all are in the last
    shard = F.coalesce(F.least(F.floor((F.col("__r") - 1) / F.nullif(size, F.lit(0))) + 1, F.lit(n)), F.lit(n))
    return ranked.withColumn(out, shard.cast("long")).drop("__r")


def matched_negatives(
    annotations: DataFrame, seed: str, by: str = "pid", key: str = "aid", diameter: str = "d",
    on_short: str = "take_all",
) -> DataFrame:
    """All positives and, per patient, as many random negatives without replacement.

    Patients without positives drop out. With fewer negatives than positives either all are taken
    or, with ``on_short='error'``, the job fails.
    """
    pos = annotations.filter(F.col(diameter) > 0)
    neg = annotations.filter(F.col(diameter) == 0)
    wanted = pos.groupBy(by).agg(F.count(F.lit(1)).alias("__want"))
    ranked = shuffle_rank(neg, seed, [by, key], [by], "__r").join(wanted, by)
    chosen = ranked.filter(F.col("__r") <= F.col("__want")).drop("__r", "__want")
    if on_short == "error":
        have = neg.groupBy(by).agg(F.count(F.lit(1)).alias("__have"))
        short = wanted.join(have, by, "left").withColumn(
            "__ok",
            F.when(F.coalesce("__have", F.lit(0)) >= F.col("__want"), F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("too few negatives: "), F.col(by).cast("string"))).cast("boolean")
            ),
        )
        chosen = chosen.join(short.filter("__ok").select(by), by, "left_semi")
    elif on_short != "take_all":
        raise ValueError("on_short is 'take_all' or 'error'")
    return pos.unionByName(chosen)


def one_per_group(df: DataFrame, seed: str, by: str = "pid", key: str = "aid") -> DataFrame:
    """One uniformly chosen key per group; an aggregate, so hot groups combine early."""
    return df.groupBy(by).agg(F.min_by(F.col(key), F.struct(uniform(seed, by, key), F.col(key))).alias(key))


def positive_share_batches(
    annotations: DataFrame, batch: int, share: float, seed: str, by: str = "pid", key: str = "aid",
    diameter: str = "d",
) -> DataFrame:
    """Shuffled patients in batches; the first rint(batch * share) slots draw a positive annotation of
    their patient, the others a negative one. Patients without positives are left out."""
    n_pos = round(batch * share)
    u = F.struct(uniform(seed, by, key), F.col(key))
    pos, neg = F.col(diameter) > 0, F.col(diameter) == 0
    per = annotations.groupBy(by).agg(
        F.min_by(F.col(key), F.when(pos, u)).alias("__pos"), F.min_by(F.col(key), F.when(neg, u)).alias("__neg"),
        F.count_if(pos).alias("__n"),
    ).filter("__n > 0")
    ranked = shuffle_rank(per, seed, [by], out="__r")
    slot = (F.col("__r") - 1) % batch
    return ranked.select(
        F.floor((F.col("__r") - 1) / batch).cast("long").alias("batch_id"), slot.alias("slot"), by,
        F.when(slot < n_pos, F.col("__pos")).otherwise(F.col("__neg")).alias(key),
        (slot < n_pos).alias("positive"),
    )


def two_pool_batches(
    annotations: DataFrame, batch: int, share: float, seed: str, by: str = "pid", key: str = "aid",
    diameter: str = "d", full_only: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """Batches of rint(batch * share) patients with positives and the rest patients with negatives
    only, aligned by batch; negatives beyond the last positive batch are not used.

    ``keep`` names columns of the drawn annotation to carry along. Annotations are read once.
    """
    n_pos = round(batch * share)
    n_neg = batch - n_pos
    u = F.struct(uniform(seed, by, key), F.col(key))
    pos = F.col(diameter) > 0
    drawn = F.struct(key, *keep)
    # one row per patient; both pools read it several times
    per = cut(annotations.groupBy(by).agg(
        F.count_if(pos).alias("__n"), F.min_by(drawn, F.when(pos, u)).alias("__pos"),
        F.min_by(drawn, F.when(~pos, u)).alias("__neg"),
    ))

    def pool(side: DataFrame, n: int, pick: str, positive: bool) -> DataFrame:
        ranked = shuffle_rank(side, seed, [by], out="__r")
        return ranked.select(
            F.floor((F.col("__r") - 1) / n).cast("long").alias("batch_id"), by, F.col(pick)[key].alias(key),
            F.lit(positive).alias("positive"), *[F.col(pick)[c].alias(c) for c in keep],
        )

    positive = pool(per.filter("__n > 0"), n_pos, "__pos", True)
    negative = pool(per.filter("__n = 0"), n_neg, "__neg", False)
    used = negative.join(positive.select("batch_id").distinct(), "batch_id", "left_semi")
    out = positive.unionByName(used)
    if full_only:
        full = out.groupBy("batch_id").count().filter(F.col("count") == batch).select("batch_id")
        out = out.join(full, "batch_id", "left_semi")
    return out


def _numbers(count: DataFrame, column: str, out: str, block: int = 1 << 16) -> DataFrame:
    """0 to n - 1 for the one row n of ``count``, made in blocks by many tasks."""
    n = F.col(column)
    starts = count.filter(n > 0).select(column, F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(block).cast("long"))).alias("__start"))
    dealt = starts.repartition(int(count.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__start")
    return dealt.select(F.explode(F.sequence("__start", F.least(F.col("__start") + (block - 1), n - 1))).alias(out))


def fixed_ratio_epoch(
    annotations: DataFrame, share: float, seed: str, by: str = "pid", key: str = "aid", diameter: str = "d",
) -> DataFrame:
    """All positives plus negatives drawn with replacement up to the wanted share of positives.

    A draw picks a patient uniformly, then one of the patient's negatives uniformly; both picks are
    equi joins on running numbers, so draws spread evenly however large a patient is.
    """
    pos = annotations.filter(F.col(diameter) > 0)
    neg = annotations.filter(F.col(diameter) == 0)
    # numbers of rows stay columns, so nothing runs while the plan is built
    n_pos = F.col("__pos")
    n_draws = (F.floor(n_pos + F.lit((1.0 - share) / share) * n_pos) - n_pos).cast("long")
    count = pos.agg(F.count(F.lit(1)).alias("__pos")).select(n_draws.alias("__many"))
    patients = shuffle_rank(
        neg.groupBy(by).agg(F.count(F.lit(1)).alias("__n")), seed, [by], out="__patient"
    )
    n_patients = neg.select(by).distinct().agg(F.count(F.lit(1))).scalar()
    draws = _numbers(count, "__many", "id").select(
        F.col("id").alias("draw"),
        (F.floor(uniform(seed + "-patient", "id") * n_patients) + 1).cast("long").alias("__patient"),
        uniform(seed + "-item", "id").alias("__v"),
    )
    picked = draws.join(patients, "__patient").withColumn(
        "__item", (F.floor(F.col("__v") * F.col("__n")) + 1).cast("long")
    )
    numbered = shuffle_rank(neg.select(by, key), seed, [by, key], [by], "__item")
    negatives = picked.join(numbered, [by, "__item"]).select(by, key, "draw", F.lit(False).alias("positive"))
    return pos.select(by, key, F.lit(None).cast("long").alias("draw"), F.lit(True).alias("positive")).unionByName(negatives)


def balanced_stream(labels: DataFrame, seed: str, key: str = "pid", label: str = "label") -> DataFrame:
    """A fair coin picks the next negative or a random positive until the negatives run out.

    The number of positives before each negative of such a stream is geometric with mean one, so
    every shuffled negative draws its own count; (turn, draw) is the stream order and the negative
    comes last in its turn.
    """
    neg = shuffle_rank(labels.filter(F.col(label) == 0).select(key), seed, [key], out="turn")
    pos = shuffle_rank(labels.filter(F.col(label) == 1).select(key), seed, [key], out="__p")
    n_pos = labels.filter(F.col(label) == 1).agg(F.count(F.lit(1))).scalar()
    u = 1 - uniform(seed + "-coin", "turn")
    many = F.floor(-F.log(u) / F.log(F.lit(2.0))).cast("int")
    draws = neg.withColumn("__many", many).filter("__many > 0").select(
        "turn", F.explode(F.sequence(F.lit(1), F.col("__many"))).alias("draw")
    ).withColumn("__p", (F.floor(uniform(seed + "-draw", "turn", "draw") * n_pos) + 1).cast("long"))
    positives = draws.join(pos, "__p").select("turn", "draw", key, F.lit(1).alias(label))
    negatives = neg.select("turn", F.lit(0).alias("draw"), key, F.lit(0).alias(label))
    return positives.unionByName(negatives)


def weighted_draw(
    df: DataFrame, n: int, pool: int, weight: str, seed: str, by: str = "pid", cid: str = "cid"
) -> DataFrame:
    """n of the top ``pool`` rows of each group, without replacement, probability by weight.

    Ordering by -ln(u) / w has the law of successive weighted draws.
    """
    best = top_n(df, pool, weight, by, cid, "__r").withColumn(
        "__race", -F.log(F.greatest(uniform(seed, by, cid), F.lit(2.0**-53))) / F.col(weight)
    )
    w = Window.partitionBy(by).orderBy("__race", cid)
    return best.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n).drop("__r", "__race")


def label_dependent_pick(
    df: DataFrame, labels: DataFrame, n: int, pool: int, seed: str, score: str = "p", by: str = "pid",
    cid: str = "cid", label: str = "label",
) -> DataFrame:
    """First n of positive patients; n random of the first ``pool`` for the others."""
    best = top_n(df, max(n, pool), score, by, cid, "__r").join(labels.select(by, label), by, "left")
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    key = F.when(positive, F.col("__r").cast("double")).otherwise(uniform(seed, by, cid))
    w = Window.partitionBy(by).orderBy("__key", cid)
    return (
        best.filter(positive | (F.col("__r") <= pool)).withColumn("__key", key)
        .withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n).drop("__r", "__key")
    )


def shuffled_top(df: DataFrame, n: int, seed: str, score: str = "p", by: str = "pid", cid: str = "cid") -> DataFrame:
    """The first n of each group in random order (``slot`` from 1)."""
    best = top_n(df, n, score, by, cid).withColumn("__u", uniform(seed, by, cid))
    w = Window.partitionBy(by).orderBy("__u", cid)
    return best.withColumn("slot", F.row_number().over(w)).drop("__u")


def epoch_batches(df: DataFrame, batch: int, seed: str, key: str = "pid", full_only: bool = False) -> DataFrame:
    """Shuffle and cut into batches; ``full_only`` drops a short tail."""
    ranked = shuffle_rank(df, seed, [key], out="__r")
    out = ranked.withColumn("batch_id", F.floor((F.col("__r") - 1) / batch).cast("long")).withColumn(
        "slot", (F.col("__r") - 1) % batch
    )
    if full_only:
        out = out.filter(F.col("batch_id") < F.floor(df.agg(F.count(F.lit(1))).scalar() / batch))
    return out.drop("__r")


def augmentation(ranges: dict[str, tuple[float, float]], seed: str, *keys: str) -> list[Column]:
    """Translation and rotation draws per axis; an axis without a range gets 0."""
    out = []
    for kind in ("translation", "rotation"):
        for axis in "zyx":
            name = f"{kind}_{axis}"
            low, high = ranges.get(name, (0.0, 0.0))
            out.append(uniform_between(low, high, f"{seed}-{name}", *keys).alias(name))
    return out


def k_folds(df: DataFrame, k: int, seed: str, key: str = "pid", label: str = "label", out: str = "fold") -> DataFrame:
    """Stratified fold ids 0..k-1."""
    ranked = shuffle_rank(df, seed, [key], [label], "__r")
    return ranked.withColumn(out, ((F.col("__r") - 1) % k).cast("int")).drop("__r")


def random_centre(shape: Sequence[Column], patch: Sequence[int], seed: str, *keys: str) -> list[Column]:
    """Integer patch centres at least half a patch inside each axis (upper end excluded)."""
    out = []
    for axis, n, p in zip("zyx", shape, patch):
        half = p // 2
        u = uniform(f"{seed}-{axis}", *keys)
        out.append((F.lit(half) + F.floor(u * (n - 2 * half))).cast("int").alias(f"c{axis}"))
    return out
