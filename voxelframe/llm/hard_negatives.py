"""Hard negatives of anchor vectors, found behind segment summaries.

Vectors are cut to integers, so scores are exact inner products. A vector's segments are summed up by their mean and deviation: over a
segment of L components the product of two vectors is L times the product of the means, plus or minus at most L times the product of the
deviations. The sums over all segments bound a score from both sides. ``LEVELS`` says into how many segments the vectors are cut, coarse
first: rows whose bounds can't meet any range of scores that is still open are dropped, the rest go to the next level
and last to the exact score. The ranges close from below as better rows are found.

An anchor's positives are its first rows of the same label; a range of scores follows from each positive, and the first rows of other
labels inside it are the negatives. Both are searches of all anchors against all rows in blocks (:mod:`blocks`): a block gives
its first few rows for each range, and the first of those are the result, so a label of any size is never one group.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows with the same id the one
with the smallest label, then vector, counts; a shorter vector counts as zero where others go on; an anchor without
another row of its label has no positives and no rows; a positive without a negative in its range gives no rows; components
of 2 ** 23 or more, or scores beyond 63 bits, raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.blocks import against_blocks, number_of_blocks
from voxelframe.llm.text import spread
from voxelframe.session import cut

SCALE = 256
LEVELS = (1, 4, 16)
TILE = 4096
BLOCK_ROWS, SMALL_BLOCK = 131_072, 4096
POSITIVES = NEGATIVES = 5
LOW_PERCENT, HIGH_PERCENT = 80, 100
EXACT = 2**53


def quantised(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, vec (32-bit little-endian integers: floor of ``scale`` times each component), one row per id."""
    slim = rows.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec")
    ).filter("vec_id is not null and label is not null and vec is not null")

    def run(batches):
        for b in batches:
            vec = b.column(2)
            lens = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lens)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            good = np.flatnonzero(bad[ends] == bad[ends - lens])
            x = np.floor(scale * x[spread((ends - lens)[good], lens[good])])
            if len(x) and np.abs(x).max() >= 2**31:
                raise ValueError("a component is too large")
            offs = 4 * np.concatenate(([0], np.cumsum(lens[good])))
            data = pa.Array.from_buffers(pa.large_binary(), len(good), [None, pa.py_buffer(offs), pa.py_buffer(x.astype("<i4"))])
            at = pa.array(good)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0).take(at), "label": b.column(1).take(at), "vec": data.cast(pa.binary())})

    found = slim.mapInArrow(run, "vec_id long, label long, vec binary")
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def matrix(vectors: pa.Array) -> np.ndarray:
    """Integer vectors as float64 rows, shorter ones filled with zeros."""
    parts = [np.frombuffer(v.as_buffer(), "<i4") for v in vectors]
    out = np.zeros((len(parts), max(map(len, parts), default=0)))
    for row, p in zip(out, parts):
        row[: len(p)] = p
    return out


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of each row, both times the root of the segment's length."""
    d = x.shape[1]
    edges = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    if d == 0:
        return np.zeros((len(x), 1)), np.zeros((len(x), 1))
    lens = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lens
    rest = x - np.repeat(mean, lens, axis=1)
    return mean * np.sqrt(lens), np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))


class Block:
    """A block of rows, sorted by label."""

    def __init__(self, t: pa.Table, levels=LEVELS):
        label, ids = t.column("label").to_numpy(), t.column("vec_id").to_numpy()
        order = np.lexsort((ids, label))
        self.label, self.ids = label[order], ids[order]
        self.x = matrix(t.column("vec").combine_chunks())[order]
        self.largest = float(np.abs(self.x).max(initial=0))
        self.norm = float(np.sqrt((self.x * self.x).sum(axis=1).max(initial=0)))
        self.levels = [(k, *summaries(self.x, k)) for k in levels]

    def fit(self, q: np.ndarray) -> np.ndarray:
        """The query with as many components as the rows; the rows grow if it is longer."""
        d = self.x.shape[1]
        if len(q) > d:
            self.x = np.pad(self.x, ((0, 0), (0, len(q) - d)))
            self.levels = [(k, *summaries(self.x, k)) for k, _, _ in self.levels]
        return np.pad(q, (0, max(0, d - len(q))))

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        bound = self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q))
        if bound < EXACT:
            return (self.x[at] @ q).astype(np.int64)
        if bound >= 2**63:
            raise OverflowError("a score needs more than 63 bits")
        return self.x[at].astype(np.int64) @ q.astype(np.int64)

    def first(self, q: np.ndarray, parts: list[tuple[int, int]], ranges: list[tuple[float, float]], k: int, skip: int | None = None):
        """For each range of scores its first ``k`` rows (score descending, then id) among these stretches of rows: (ids, scores)."""
        q = self.fit(q)
        mine = [tuple(s[0] for s in summaries(q[None], n)) for n, _, _ in self.levels]
        slack = 0.5 + 1e-12 * self.norm * float(np.sqrt(q @ q))
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ranges]
        floors = [low for low, _ in ranges]
        for lo, hi in ((a, min(a + TILE, b)) for x, b in parts for a in range(x, b, TILE)):
            at = np.arange(lo, hi)
            if skip is not None:
                at = at[self.ids[at] != skip]
            for (_, mean, deviation), (m, d) in zip(self.levels, mine):
                middle, reach = mean[at] @ m, deviation[at] @ d + slack
                open_ = np.zeros(len(at), bool)
                for floor, (_, high) in zip(floors, ranges):
                    open_ |= (middle + reach >= floor) & (middle - reach <= high)
                at = at[open_]
                if not len(at):
                    break
            if not len(at):
                continue
            s = self.scores(at, q)
            for r, (_, high) in enumerate(ranges):
                inside = np.flatnonzero((s >= floors[r]) & (s <= high))
                if not len(inside):
                    continue
                ids, got = np.append(best[r][0], self.ids[at[inside]]), np.append(best[r][1], s[inside])
                order = np.lexsort((ids, -got))[:k]
                best[r] = ids[order], got[order]
                if len(order) == k:
                    floors[r] = max(floors[r], int(got[order[-1]]))
        return best

    def stretch(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, "right"))


def _ranked(found: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives(rows: DataFrame, anchors: DataFrame, n: int, k: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_id, positive_score: the first ``k`` other rows of each anchor's label. Both tables as of :func:`quantised`."""

    def answer(block, queries):
        out = []
        for i, label, q in zip(queries["vec_id"].to_pylist(), queries["label"].to_pylist(), matrix(queries["vec"].combine_chunks())):
            ((ids, s),) = block.first(q, [block.stretch(label)], [(-np.inf, np.inf)], k, i)
            out.append((np.full(len(ids), i), ids, s))
        a, p, s = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_pydict({"anchor_id": a, "positive_id": p, "positive_score": s})

    found = against_blocks(rows, anchors, n, "vec_id", Block, answer, "anchor_id long, positive_id long, positive_score long")
    return _ranked(found, ["anchor_id"], "positive_score", "positive_id", k).drop("rank")


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT, block_rows: int = BLOCK_ROWS, small_block: int = SMALL_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: a condition on vec_id and label. A negative's score is ``low_percent`` to ``high_percent`` of the positive's.
    """
    data = cut(quantised(rows, vec_id, label, vector))
    anchors = data.filter(is_anchor)
    n = number_of_blocks(data.count(), block_rows, small_block)
    pos = cut(positives(data, anchors, n, n_positives))
    wanted = pos.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("wanted"))
    queries = anchors.join(wanted, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vec", "wanted")

    def answer(block, queries):
        out = []
        for i, label, q, wanted in zip(queries["vec_id"].to_pylist(), queries["label"].to_pylist(), matrix(queries["vec"].combine_chunks()), queries["wanted"].to_pylist()):
            lo, hi = block.stretch(label)
            ranges = [(-(-low_percent * w["positive_score"] // 100), high_percent * w["positive_score"] // 100) for w in wanted]
            for w, (ids, s) in zip(wanted, block.first(q, [(0, lo), (hi, len(block.ids))], ranges, n_negatives)):
                out.append((np.full(len(ids), i), np.full(len(ids), w["positive_id"]), np.full(len(ids), w["positive_score"]), ids, s))
        if out:
            a, p, ps, ids, s = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_pydict({"anchor_id": a, "positive_id": p, "positive_score": ps, "negative_id": ids, "negative_score": s})

    found = against_blocks(data, queries, n, "vec_id", Block, answer, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
