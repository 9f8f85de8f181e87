"""Overlap of blobs, pruning and merging of detections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.joins import AXES
from voxelframe.plans.bricks import same_as_before, whole_groups
from voxelframe.plans.ordered import BUCKET, range_buckets
from voxelframe.plans.spatial import drop_when_near_sized, met_when_near_sized, squared_distance
from voxelframe.session import cut, sound_unions, uncut

# Merging of close neighbours.
MERGE_DISTANCE = 16.0
MERGE_Z_SCALE = 2.5


def disk_overlap(d: Column, r1: Column, r2: Column) -> Column:
    """Area of the lens of two crossing disks over the area of the smaller disk."""

    def half_angle(r: Column, other: Column) -> Column:
        cosine = (d * d + r * r - other * other) / (2 * d * r)
        return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))

    kite = F.sqrt(F.abs((r1 + r2 - d) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2))) / 2
    lens = r1 * r1 * half_angle(r1, r2) + r2 * r2 * half_angle(r2, r1) - kite
    small = F.least(r1, r2)
    return lens / (F.lit(math.pi) * small * small)


def sphere_overlap(d: Column, r1: Column, r2: Column) -> Column:
    """Volume of the lens of two crossing spheres over the volume of the smaller sphere."""
    gap = r1 + r2 - d
    lens = F.lit(math.pi) * gap * gap * (
        d * d + 2 * d * (r1 + r2) - 3 * (r1 * r1 + r2 * r2) + 6 * r1 * r2
    ) / (12 * d)
    small = F.least(r1, r2)
    return lens / (F.lit(4.0 / 3.0 * math.pi) * small * small * small)


def blob_overlap(d: Column, sigma1: Column, sigma2: Column, n_dim: int = 3) -> Column:
    """Overlap fraction of blobs of radius sigma * sqrt(n): 0 apart, 1 contained."""
    root = F.lit(math.sqrt(n_dim))
    r1, r2 = sigma1 * root, sigma2 * root
    crossing = disk_overlap(d, r1, r2) if n_dim == 2 else sphere_overlap(d, r1, r2)
    return (
        F.when(d > r1 + r2, F.lit(0.0)).when(d <= F.abs(r1 - r2), F.lit(1.0)).otherwise(crossing)
    )


def _rival(blobs: DataFrame, by: str, cid: str) -> DataFrame:
    return blobs.select(
        by, F.col(cid).alias("__oid"), *[F.col(c).alias(f"__o{c}") for c in AXES], F.col("sigma").alias("__osigma")
    )


def _reach(sigma: str) -> Column:
    """The diameter of a blob."""
    return F.col(sigma) * F.lit(2 * math.sqrt(3))


def _conflict(overlap: float, outranks: Column) -> Column:
    axes = [f"__o{c}" for c in AXES]
    d = F.sqrt(squared_distance(AXES, axes))
    return outranks & (blob_overlap(d, F.col("sigma"), F.col("__osigma")) > F.lit(overlap))


def _one_per_place(blobs: DataFrame, by: str, cid: str, pick) -> DataFrame:
    """One row for blobs equal in place and size: none of the others survives any pruning."""
    keys = [by, *AXES, "sigma"]
    rest = [c for c in blobs.columns if c not in keys]
    best = pick(F.struct(*[F.col(c) for c in rest]), F.col(cid)).alias("__best")
    return blobs.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}") for c in rest])


def prune(
    blobs: DataFrame, overlap: float = 0.5, by: str = "pid", cid: str = "cid", width: float = 32.0
) -> DataFrame:
    """One-pass pruning: a blob goes when any larger one overlaps it by more than the limit.

    Equal sizes remove the lower id. An overlapping rival is at least as large, hence no further away
    than its own diameter: a rival stands in the few cells of a grid of its own size, a victim looks into one cell of each grid
    from its own size on and leaves by an anti join, so no pair of blobs is ever a row and a blob of any size fills few cells.
    """
    distinct = _one_per_place(blobs, by, cid, F.max_by)
    rivals = _rival(distinct, by, cid)
    outranks = (F.col("__osigma") > F.col("sigma")) | (
        (F.col("__osigma") == F.col("sigma")) & (F.col("__oid") > F.col(cid))
    )
    return drop_when_near_sized(
        distinct, rivals, by, cid, AXES, [f"__o{c}" for c in AXES], _reach("__osigma"), _reach("sigma"), width, _conflict(overlap, outranks)
    )


def prune_greedy(
    blobs: DataFrame, overlap: float = 0.5, by: str = "pid", cid: str = "cid", width: float = 32.0,
) -> DataFrame:
    """Greedy pruning: by size descending, then position and id, keep a blob unless it overlaps a kept one.

    Computed in rounds over all patients at once: blobs without an undecided better rival are kept, the undecided ones overlapping a
    kept blob go; the first round, with most of the blobs, writes the others only. The best undecided blob of a patient has no better
    rival, so every round decides some, and the loop ends. The result equals the sequential loop.
    """
    axes = [f"__o{c}" for c in AXES]
    mine = F.struct(-F.col("sigma"), *[F.col(c) for c in AXES], F.col(cid))
    other = F.struct(-F.col("__osigma"), *[F.col(c) for c in axes], F.col("__oid"))
    sizes = _reach("__osigma"), _reach("sigma")
    every = cut(_one_per_place(blobs, by, cid, F.min_by))
    conflict = _conflict(overlap, other < mine)

    def met(some: DataFrame, rivals: DataFrame) -> DataFrame:
        return met_when_near_sized(some, _rival(rivals, by, cid), by, cid, AXES, axes, *sizes, width, conflict)

    def without(some: DataFrame, ids: DataFrame) -> DataFrame:
        return some.join(ids, [by, cid], "left_anti")

    # most blobs have no better rival and are kept at once; only the others are written and take part in the rounds
    outranked = cut(every.join(met(every, every), [by, cid], "left_semi"))
    gone = cut(met(outranked, without(every, outranked.select(by, cid))))
    undecided = cut(without(outranked, gone))
    while not undecided.isEmpty():
        won = cut(without(undecided, met(undecided, undecided)))
        rest = without(undecided, won.select(by, cid))
        lost = cut(met(rest, won))
        gone = gone.unionByName(lost)
        undecided = cut(without(rest, lost))
    return without(every, gone)


# --- close neighbours ------------------------------------------------------------------------


def merge_close(
    candidates: DataFrame, distance: float = MERGE_DISTANCE, z_scale: float = MERGE_Z_SCALE, by: str = "pid",
    cid: str = "cid", score: str = "p", cells: int = 8, per_block: int = 20_000,
) -> DataFrame:
    """Keep one of close candidates, in id order.

    A candidate closer than the distance to a kept one (the earliest kept counts) takes its place if
    its score is higher and is dropped otherwise.

    Each step depends on what came before, so the result is found as a fixed point. Space is cut into cells of ``cells`` distances
    and a cell, where it is crowded, into stretches of ids: blocks of about ``per_block`` candidates at most. A round runs the steps of every block
    side by side, with the lives (kept from, replaced at) that the last round found for candidates next to the block or before
    it. The first step that isn't yet right has only right ones before it, so each round settles more, and rounds end
    when none changes a life: then every step has seen what the loop over all candidates would have seen. The number of rounds follows the
    longest chain of replacements across blocks, not the size of a group. A candidate without any other within the distance meets none in
    any step: it stays, and only the others take part in the rounds. A patient with ``per_block`` candidates at most is one block, so its
    steps are run once, without rounds.

    Ids are unique in a patient. A candidate without a position is close to nothing and stays.
    """
    rows = candidates.select(
        F.col(by).alias("pid"), F.col(cid).alias("cid"), *[F.col(c).cast("double").alias(c) for c in AXES], F.col(score).cast("double").alias("score")
    ).filter("z is not null and y is not null and x is not null")
    width = cells * distance
    axes = (("cz", "z", z_scale), ("cy", "y", 1.0), ("cx", "x", 1.0))
    block = ["pid", *[c for c, _, _ in axes]]
    rows = rows.withColumns({c: F.floor(F.col(a) * F.lit(s) / F.lit(width)) for c, a, s in axes})
    rows = _with_others_near(rows, distance, width, axes)
    # both tables have a row for so many candidates, or partitions, at most
    crowded = F.broadcast(rows.groupBy("pid").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > per_block).select(F.col("pid").alias("__cpid"), "__n"))
    rows = rows.join(crowded, F.col("pid").eqNullSafe(F.col("__cpid")), "left").withColumns({c: F.when(F.col("__n").isNull(), 0).otherwise(F.col(c)).cast("long") for c in block[1:]})
    dealt = range_buckets(rows.drop("__cpid", "__n"), block, [F.asc("cid")], per_block).withColumnRenamed(BUCKET, "part")
    blocks = cut(dealt.groupBy(*block, "part").agg(F.min("cid").alias("__lo"), F.max("cid").alias("__hi")))
    split = F.broadcast(blocks.groupBy("pid").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("pid").alias("__cpid")))
    apart = F.col("pid").eqNullSafe(F.col("__cpid"))
    gone = _merged_away(dealt.join(split, apart, "left_anti"), distance, z_scale)
    if not split.isEmpty():
        gone = gone.unionByName(_merged_in_rounds(dealt.join(split, apart, "left_semi"), blocks, distance, z_scale, width, axes))
    return candidates.join(gone, F.col(by).eqNullSafe(F.col("__pid")) & (F.col(cid) == F.col("__cid")), "left_anti")


def _merged_away(rows: DataFrame, distance: float, z_scale: float) -> DataFrame:
    """(__pid, __cid) of the candidates of ``rows`` that don't stay: every patient is one block and runs its steps once."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    n = int(sound_unions(rows.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    steps = _merge_blocks(distance, z_scale, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, 1):
            groups = pa.array(np.cumsum(~same_as_before(b.columns[:1])))
            none, two = pa.nulls(len(b), pa.int64()), pa.array(np.full(len(b), 2, np.int32))
            block = [groups, *[none] * 4, two, *b.columns[1:], pa.nulls(len(b), b.schema.field("cid").type)]
            names = ["pid", "cz", "cy", "cx", "part", "kind", "cid", *AXES, "score", "death"]
            found = pa.Table.from_batches(list(steps([pa.RecordBatch.from_arrays(block, names)])))
            stay = found.filter(pc.is_null(found["own"]))
            left = set(zip(stay["pid"].to_pylist(), stay["cid"].to_pylist()))
            left -= set(zip(*(found.filter(pc.is_valid(found["own"]))[c].to_pylist() for c in ("pid", "cid"))))
            gone = pa.array([i not in left for i in zip(groups.to_pylist(), b.column(1).to_pylist())])
            yield pa.RecordBatch.from_arrays([b.column(i).filter(gone) for i in (0, 1)], ["__pid", "__cid"])

    dealt = rows.select("pid", "cid", *AXES, "score").repartition(n, "pid").sortWithinPartitions("pid", "cid")
    return dealt.mapInArrow(run, f"__pid {kinds['pid']}, __cid {kinds['cid']}")


def _merged_in_rounds(dealt: DataFrame, blocks: DataFrame, distance: float, z_scale: float, width: float, axes) -> DataFrame:
    """(__pid, __cid) of the candidates of ``dealt`` that don't stay, by rounds over blocks. Patients in one cell stand at 0 on each axis."""
    block = ["pid", *[c for c, _, _ in axes]]
    kind_of = {f.name: f.dataType.simpleString() for f in dealt.schema}
    lives_schema = (
        f"pid {kind_of['pid']}, cid {kind_of['cid']}, stays boolean, z double, y double, x double, score double, cz long, cy long, cx long, "
        f"part long, own {kind_of['cid']}, other {kind_of['cid']}"
    )
    order = [*block, "part", "kind", "cid", *AXES, "score", "death"]
    mine = dealt.withColumn("kind", F.lit(2)).withColumn("death", F.lit(None).cast(kind_of["cid"])).select(*order)
    lives, state = dealt.sparkSession.createDataFrame([], lives_schema), None
    while True:
        death = F.least("own", "other")
        near = lives.withColumn("death", death)
        for c, a, s in axes:
            at = F.col(a) * F.lit(s)
            cells = F.sequence(F.floor((at - distance) / width), F.floor((at + distance) / width))
            near = near.withColumn(f"__{c}", F.explode(F.array_distinct(F.concat(cells, F.array(F.lit(0).cast("long"))))))
        there = blocks.select(*[F.col(c).alias(f"__b_{c}") for c in (*block, "part")], "__lo", "__hi")
        same_cell = F.col("pid").eqNullSafe(F.col("__b_pid"))
        for c in block[1:]:
            same_cell = same_cell & (F.col(f"__{c}") == F.col(f"__b_{c}"))
        elsewhere = (F.col("part") != F.col("__b_part")) | (F.col("cz") != F.col("__b_cz")) | (F.col("cy") != F.col("__b_cy")) | (F.col("cx") != F.col("__b_cx"))
        alive = (F.col("cid") < F.col("__hi")) & (F.col("death").isNull() | (F.col("death") >= F.col("__lo")))
        met = near.join(there, same_cell & elsewhere & alive).select(
            *[F.col(f"__b_{c}").alias(c) for c in (*block, "part")], F.lit(0).alias("kind"), "cid", *AXES, "score", "death"
        )
        ends = lives.filter("other is not null").withColumn("kind", F.lit(1)).withColumn("death", F.col("other")).select(*order)
        n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = met.unionByName(ends).unionByName(mine).repartition(n, *block, "part").sortWithinPartitions(*block, "part", "kind", "cid")
        found = sorted_.mapInArrow(_merge_blocks(distance, z_scale, block), lives_schema)
        old, lives = lives, cut(
            found.groupBy("pid", "cid").agg(*[F.max(c).alias(c) for c in ("stays", *AXES, "score", "cz", "cy", "cx", "part")], F.min("own").alias("own"), F.min("other").alias("other")).filter("stays")
        )
        before, state = state, lives.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pid", "cid", "own", "other").cast("decimal(38,0)"))).first()
        if before is not None:
            uncut(old)  # nothing reads it any more
        if state == before:
            break
    kept = lives.filter("own is null and other is null").select(F.col("pid").alias("__kpid"), F.col("cid").alias("__kcid"))
    gone = dealt.join(kept, F.col("pid").eqNullSafe(F.col("__kpid")) & (F.col("cid") == F.col("__kcid")), "left_anti")
    return gone.select(F.col("pid").alias("__pid"), F.col("cid").alias("__cid"))


def _with_others_near(rows: DataFrame, distance: float, width: float, axes) -> DataFrame:
    """Rows with another of their patient within the distance (a little more is no harm); no pair is emitted."""
    reach = distance * (1 + 1e-9)
    other = rows.select(*[F.col(c).alias(f"__o_{c}") for c in ("pid", "cid", *AXES)])
    on, d2 = F.col("pid").eqNullSafe(F.col("__o_pid")) & (F.col("cid") != F.col("__o_cid")), F.lit(0.0)
    for c, a, s in axes:
        at, gap = F.col(f"__o_{a}") * F.lit(s), (F.col(a) - F.col(f"__o_{a}")) * F.lit(s)
        other = other.withColumn(f"__o_{c}", F.explode(F.sequence(F.floor((at - reach) / width), F.floor((at + reach) / width))))
        on, d2 = on & (F.col(c) == F.col(f"__o_{c}")), d2 + gap * gap
    return rows.join(other, on & (F.sqrt(d2) <= reach), "left_semi")


def _merge_blocks(distance: float, z_scale: float, block: list[str]):
    """The steps of each block of a sorted stream: kept candidates around it, ends of its own that others bring, its candidates in id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        key, places, ends, out = None, {}, {}, []

        def cell(p):
            return math.floor(p[1] * z_scale / distance), math.floor(p[2] / distance), math.floor(p[3] / distance)

        def step(p):
            """p: [id, z, y, x, score, end, mine, replaced by]."""
            cz, cy, cx = cell(p)
            first = None
            for z in (cz - 1, cz, cz + 1):
                for y in (cy - 1, cy, cy + 1):
                    for x in (cx - 1, cx, cx + 1):
                        for k in places.get((z, y, x), ()):
                            if (
                                k[0] < p[0] and k[7] is None and (k[5] is None or k[5] >= p[0]) and (first is None or k[0] < first[0])
                                and math.sqrt(((p[1] - k[1]) * z_scale) ** 2 + (p[2] - k[2]) ** 2 + (p[3] - k[3]) ** 2) < distance
                            ):
                                first = k
            if first is not None:
                if not p[4] > first[4]:
                    return
                first[7] = p[0]
                places[cell(first)].remove(first)
                if not first[6]:
                    out.append((first[0], None, None, None, None, None, None, p[0]))
            places.setdefault(cell(p), []).append(p)
            out.append(p)

        def flush():
            if not out:
                return
            pid, part = key[0], key[4]
            stays = [len(p) == 8 and p[1] is not None for p in out]
            cols = {
                "pid": [pid] * len(out), "cid": [p[0] for p in out], "stays": [s or None for s in stays], **{c: [p[i] if s else None for p, s in zip(out, stays)] for i, c in ((1, "z"), (2, "y"), (3, "x"), (4, "score"))},
                **{c: [key[i] if s else None for s in stays] for i, c in ((1, "cz"), (2, "cy"), (3, "cx"))}, "part": [part if s else None for s in stays],
                "own": [p[7] if s else None for p, s in zip(out, stays)], "other": [None if s else p[7] for p, s in zip(out, stays)],
            }
            types = {"pid": schema.field("pid").type, **dict.fromkeys(("cid", "own", "other"), schema.field("cid").type), "stays": pa.bool_(), **dict.fromkeys(("z", "y", "x", "score"), pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in cols.items()], list(cols))

        for b in batches:
            schema = b.schema
            names = [b.column(i).to_pylist() for i in range(5)]
            kinds, ids, *numbers = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "cid", *AXES, "score", "death"))
            for *here, kind, i, z, y, x, p, death in zip(*names, kinds, ids, *numbers):
                if here != key:
                    yield from flush()
                    key, places, ends, out = here, {}, {}, []
                p = math.nan if p is None else p
                if kind == 0:
                    place = [i, z, y, x, p, death, False, None]
                    places.setdefault(cell(place), []).append(place)
                elif kind == 1:
                    ends[i] = death
                else:
                    step([i, z, y, x, p, ends.get(i), True, None])
        yield from flush()

    return run
