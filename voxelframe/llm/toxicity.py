"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct lower-case words, pairs of neighbours and pairs one word apart, hashed to ``2 ** BITS``
slots. Training follows each coordinate with a rate of its own; the L1 term keeps most weights at exactly zero, so the model
is a short list of slots and weights, at most ``2 ** BITS`` and in practice a few thousand, sent to the tasks by value.

The classifier is fitted on at most ``MAX_TRAIN`` labelled rows, those with the smallest hash of their id, in one task
that holds only their features; all rows are scored. Rows whose crc32 of the id modulo ``FOLDS`` is ``HELD_OUT`` never train.

Defined results: a null or empty text has no features and gets the bias alone; labels other than 0 and 1, or without an id,
are left out; a repeated id counts as toxic if any of its labels is, and trains with the one text of the smallest hash; without
labelled rows all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.text import NOT_ALNUM, Hasher, Texts, map_runs, mix, only

BITS = 22
MAX_TRAIN = 12_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3


def slots(hasher: Hasher, t: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all texts and the document of each, repeats included."""
    r = t.lower().ranges(NOT_ALNUM)
    h = hasher.ranges(r)
    out, of = [mix(h + np.uint64(1))], [r.of]
    for gap in (1, 2):
        if len(h) > gap:
            inside = np.flatnonzero(r.of[gap:] == r.of[:-gap])
            out.append(mix(h[inside] * np.uint64(0x9FB21C651E98DF25 + 2 * gap) + h[inside + gap]))
            of.append(r.of[inside])
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(of)


def distinct_slots(s: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((of.astype(np.int64) << bits) | s)
    return key & ((1 << bits) - 1), key >> bits


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """Slots with weights other than zero, their weights, and the bias."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    share = np.mean([y for _, y in rows]) if rows else 0
    prior = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for s, y in rows:
            w = weights(z[s], n[s])
            wb = -zb / ((beta + nb**0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb + prior, -30, 30)))
            g = p - y
            step = (np.sqrt(n[s] + g * g) - np.sqrt(n[s])) / alpha
            z[s] += g - step * w
            n[s] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at], -zb / ((beta + nb**0.5) / alpha + l2) + prior


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
    """(slots, weights, bias) from documents (doc_id, text) and labels (doc_id, toxic)."""
    chosen = (
        labels.filter("toxic in (0, 1)").filter(fold() != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_train)
    )
    # at most max_train small rows: the bound of this broadcast
    found = docs.join(F.broadcast(chosen), "doc_id").select("order", "doc_id", "toxic", F.struct(F.xxhash64("text").alias("tie"), "text").alias("t"))
    # one row per id, however often the table repeats it: the bound of the training task
    sample = found.groupBy("order", "doc_id", "toxic").agg(F.min("t").alias("t")).select("order", "doc_id", "toxic", "t.text")

    def features(hasher, rows, t):
        s, of = distinct_slots(*slots(hasher, t, bits), bits)
        offs = np.searchsorted(of, np.arange(len(t) + 1))
        data = pa.Array.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer((offs * 4).astype(np.int64)), pa.py_buffer(s.astype(np.uint32))])
        return {"order": rows.column(0), "toxic": rows.column(2), "slots": data}

    feats = map_runs(sample, "text", features, "order long, toxic int, slots binary", Hasher)

    def train(batches):
        rows = []
        for b in batches:
            for o, y, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows.append((o, s, y))
        rows.sort()
        at, w, bias = ftrl([(np.frombuffer(s, np.uint32).astype(np.int64), y) for _, s, y in rows], bits, epochs, alpha, beta, l1, l2)
        if rows:
            yield pa.RecordBatch.from_pydict({"at": pa.array([at.astype(np.uint32).tobytes()], pa.binary()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "bias": [float(bias)]})

    # a shuffle, so that only these rows and not the scan and the join run in the one task
    model = feats.repartition(1).mapInArrow(train, "at binary, w binary, bias double").collect()
    if not model:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), -30.0
    return np.frombuffer(model[0].at, np.uint32), np.frombuffer(model[0].w, np.float32), model[0].bias


def score(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    at, w, bias = model

    def make():
        table = np.zeros(1 << bits, np.float32)
        table[at] = w
        return Hasher(), table

    def run(state, rows, t):
        hasher, table = state
        s, of = slots(hasher, t, bits)
        live = np.flatnonzero(table[s])
        s, of = distinct_slots(s[live], of[live], bits)
        x = np.bincount(of, table[s], len(t)) + bias
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return {"doc_id": rows.column(0), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    slim = only(docs, doc_id=doc_id, text=text)
    kind = slim.schema["doc_id"].dataType.simpleString()
    out = map_runs(slim, "text", run, f"doc_id {kind}, score double, predicted int", make)
    return out.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
