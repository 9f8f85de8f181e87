"""Removal of repeated passages, found by phrase automata.

A phrase is ``WINDOW`` consecutive words. In every phrase the ``ANCHOR``-word gram with the smallest hash is its anchor, so two
equal phrases have equal anchors. (1) Anchors that several documents hold are found by their hashes; only phrases with such an
anchor can recur. (2) The stretches of text around these anchors, distinct within a slice of documents, go to the shard of
their anchor. (3) A shard confirms the phrases that documents with different ids hold, compiles them into an Aho-Corasick
automaton over word numbers, and streams all its stretches through it; each place found learns the smallest id that holds its
phrase. (4) The slices look up their stretches' results and remove the words of phrases that a smaller id holds.

Texts are shuffled once, by slice, and read twice from there. A passage that a third of all documents hold costs its shard one
stretch per slice, not one per document.

Defined results: null and empty texts have no words; equal ids don't repeat each other; a row without an id loses nothing and
takes nothing from others; repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.shared import PACKED, Packer, shared_pairs
from voxelframe.llm.text import Hasher, Ranges, covered, grams, map_runs, only, sized, spread, texts_of, to_long, window_minima

WINDOW = 13
ANCHOR = 5
SLICE_BYTES = 1 << 20
PIECE_BYTES = 8 << 20
SHARDS = 16


class Stretches:
    """The phrases of a run of documents by anchor: for each anchor place the first phrase, and how many choose it."""

    def __init__(self, hasher: Hasher, words: Ranges, window: int, anchor: int):
        h = hasher.ranges(words)
        self.word_hash = h
        g, at = grams(h, words.of, anchor)
        n = len(h) - window + 1
        first = np.flatnonzero(words.of[:n] == words.of[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        full = np.zeros(len(h), np.uint64)
        full[at] = g
        chosen = window_minima(full, first, window - anchor + 1)
        begin = np.flatnonzero(np.diff(chosen, prepend=-1))
        self.first = first[begin]
        self.count = np.diff(np.append(begin, len(first)))
        self.key = full[chosen[begin]]
        self.of = words.of[self.first]

    def hashes(self, at: np.ndarray, window: int) -> np.ndarray:
        """Hashes of whole stretches."""
        n = self.count[at] + window - 1
        h = np.zeros(len(at), np.uint64)
        for j in range(int(n.max(initial=0))):
            go = n > j
            h[go] = h[go] * np.uint64(0x9FB21C651E98DF25) + self.word_hash[self.first[at[go]] + j]
        return h * np.uint64(0xD6E8FEB86659FD93) + n.astype(np.uint64)


def _document_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def shared_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """key, doc_id: anchors that several documents hold."""
    pieces = sized(docs, PIECE_BYTES)

    def run(state, rows, t):
        hasher, packer = state
        s = Stretches(hasher, t.words(), window, anchor)
        ids, known = _document_ids(rows.column(0))
        mine = known[s.of]
        return packer.add(s.key[mine], ids[s.of[mine]].view(np.uint64))

    packed = map_runs(docs, "text", run, PACKED, lambda: (Hasher(), Packer(max(512, SHARDS * pieces))), lambda s: s[1].flush())

    def settle(batches):
        for key, member in shared_pairs(batches, []):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(member.view(np.int64))], ["key", "doc_id"])

    return packed.repartition(pieces, "shard").mapInArrow(settle, "key long, doc_id long")


def automaton(phrases: list[tuple[int, ...]]):
    """An Aho-Corasick automaton over sequences of word numbers; a match gives the number of its phrase."""
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, p in enumerate(phrases):
        a.add_word(p, i)
    a.make_automaton()
    return a


def locate(stretches: list[bytes], low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Confirmed phrases of distinct stretches: their number by stretch, then place and smallest document of each.

    ``low`` and ``high`` are the smallest and largest document that hold the stretch.
    """
    numbers: dict[bytes, int] = {}
    sequences = [tuple([numbers.setdefault(w, len(numbers) + 1) for w in s.split()]) for s in stretches]
    lows: dict[tuple[int, ...], int] = {}
    highs: dict[tuple[int, ...], int] = {}
    for q, lo, hi in zip(sequences, low.tolist(), high.tolist()):
        for i in range(len(q) - window + 1):
            p = q[i : i + window]
            if p in lows:
                if lo < lows[p]:
                    lows[p] = lo
                if hi > highs[p]:
                    highs[p] = hi
            else:
                lows[p], highs[p] = lo, hi
    confirmed = [p for p, lo in lows.items() if lo < highs[p]]
    first = np.array([lows[p] for p in confirmed], np.int64)
    del lows, highs
    n, ends, found = np.zeros(len(stretches), np.int64), [], []
    if confirmed:
        matches = automaton(confirmed).iter
        for k, q in enumerate(sequences):
            before = len(ends)
            for end, i in matches(q):
                ends.append(end)
                found.append(i)
            n[k] = len(ends) - before
    return n, np.array(ends, np.int64) - window + 1, first[np.array(found, np.int64)]


def _texts(table: pa.Table, column: str):
    """The whole column as one run."""
    a = table.column(column)
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return next(texts_of(pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a, 1 << 62), None)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept (the words left, joined by blanks) of every row."""
    slim = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    slices = max(256, sized(docs, SLICE_BYTES))
    pieces = sized(docs, PIECE_BYTES)
    shards = max(512, SHARDS * pieces)
    slice_of = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(slices)).cast("int").alias("slice")
    placed = slim.select(slice_of, "doc_id", "text")
    anchors = shared_anchors(slim, window, anchor).select(F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), "key", "doc_id")

    def stretches(key, texts, shared):
        """Distinct stretches around shared anchors, one row per shard."""
        schema = ["shard", "slice", "hash", "low", "high", "offsets", "data"]
        t = _texts(texts, "text")
        if t is None or not len(shared):
            return pa.table({c: pa.array([], k) for c, k in zip(schema, (pa.int32(), pa.int32(), *[pa.binary()] * 5))})
        ids, known = _document_ids(texts.column("doc_id").combine_chunks())
        words = t.words()
        s = Stretches(Hasher(), words, window, anchor)
        pairs = np.unique(np.stack((shared.column("key").to_numpy(), shared.column("doc_id").to_numpy())), axis=1)
        mine = _pair_isin(to_long(s.key), ids[s.of], pairs) & known[s.of]
        at = np.flatnonzero(mine)
        h = s.hashes(at, window)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, back, ids[s.of[at]])
        np.maximum.at(high, back, ids[s.of[at]])
        at = at[where]
        shard = ((s.key[at] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        at, shard, distinct, low, high = at[order], shard[order], distinct[order], low[order], high[order]
        begin = words.starts[s.first[at]]
        end = words.ends[s.first[at] + s.count[at] + window - 2]
        size = end - begin
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        stops = np.append(cuts[1:], len(shard))
        rows = {c: [] for c in schema}
        for a, b in zip(cuts.tolist(), stops.tolist()):
            rows["shard"].append(int(shard[a]))
            rows["slice"].append(key[0].as_py())
            rows["hash"].append(distinct[a:b].tobytes())
            rows["low"].append(low[a:b].tobytes())
            rows["high"].append(high[a:b].tobytes())
            rows["offsets"].append(np.cumsum(size[a:b]).tobytes())
            rows["data"].append(t.buf[spread(begin[a:b], size[a:b])].tobytes())
        return pa.table({c: pa.array(rows[c], k) for c, k in zip(schema, (pa.int32(), pa.int32(), *[pa.binary()] * 5))})

    sent = placed.groupBy("slice").cogroup(anchors.groupBy("slice")).applyInArrow(
        stretches, "shard int, slice int, hash binary, low binary, high binary, offsets binary, data binary"
    )

    def search(batches):
        """The automaton of each shard of the partition; rows come sorted by shard."""
        shard, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard and rows:
                    yield _answers(rows, window)
                    rows = []
                shard = r["shard"]
                rows.append(r)
        if rows:
            yield _answers(rows, window)

    found = sent.repartition(pieces, "shard").sortWithinPartitions("shard").mapInArrow(search, "slice int, hash binary, n binary, place binary, holder binary")

    def rewrite(key, texts, answers):
        t = _texts(texts, "text")
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
        if t is None:
            return pa.table({c: pa.array([], k) for c, k in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))})
        column = texts.column("doc_id").combine_chunks()
        ids, known = _document_ids(column)
        words = t.words()
        gone = np.zeros(len(words), bool)
        if len(answers):
            gone = _gone(words, ids, known, answers, window, anchor)
        keep = np.flatnonzero(~gone)
        starts, ends, of = words.starts[keep], words.ends[keep], words.of[keep]
        size = ends - starts + 1  # and a blank
        offs = np.concatenate(([0], np.cumsum(size)))
        at = spread(starts, size)
        data = t.buf[np.minimum(at, max(len(t.buf) - 1, 0))]
        data[offs[1:] - 1] = 32
        n = np.bincount(of, minlength=len(t))
        last = np.cumsum(n)
        kept = [data[offs[b - k] : max(offs[b] - 1, offs[b - k])].tobytes() for b, k in zip(last.tolist(), n.tolist())]
        out = {
            "doc_id": column, "n_words": pa.array(words.per_document(), pa.int64()), "n_removed": pa.array(np.bincount(words.of[gone], minlength=len(t)), pa.int64()),
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
        }
        return pa.table(out | ({"kept": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return placed.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(rewrite, schema)


def _pair_isin(a: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether each (a, b) is a column of ``pairs``, which is sorted."""
    ka, back = np.unique(np.concatenate((pairs[0], a)), return_inverse=True)
    kb, back_b = np.unique(np.concatenate((pairs[1], b)), return_inverse=True)
    code = back.astype(np.int64) * len(kb) + back_b
    return np.isin(code[pairs.shape[1] :], code[: pairs.shape[1]])


def _answers(rows: list[dict], window: int) -> pa.RecordBatch:
    """What a shard tells its slices; the same stretch of several slices is searched once."""
    numbers: dict[bytes, int] = {}
    places, lows, highs = [], [], []
    for r in rows:
        ends = np.frombuffer(r["offsets"], np.int64).tolist()
        data = r["data"]
        places.append(np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip([0, *ends[:-1]], ends)], np.int64))
        lows.append(np.frombuffer(r["low"], np.int64))
        highs.append(np.frombuffer(r["high"], np.int64))
    at = np.concatenate(places)
    low, high = np.full(len(numbers), np.iinfo(np.int64).max), np.full(len(numbers), np.iinfo(np.int64).min)
    np.minimum.at(low, at, np.concatenate(lows))
    np.maximum.at(high, at, np.concatenate(highs))
    n, place, holder = locate(list(numbers), low, high, window)
    start = np.cumsum(n) - n
    out = {c: [] for c in ("slice", "hash", "n", "place", "holder")}
    for r, k, top in zip(rows, places, highs):
        took = spread(start[k], n[k])
        # of use to a slice: places whose phrase a smaller document holds than some document of the slice
        of = np.repeat(np.arange(len(k)), n[k])
        good = holder[took] < top[of]
        size = np.bincount(of[good], minlength=len(k))
        some = size > 0
        if some.any():
            out["slice"].append(r["slice"])
            out["hash"].append(np.frombuffer(r["hash"], np.uint64)[some].tobytes())
            out["n"].append(size[some].tobytes())
            out["place"].append(place[took[good]].tobytes())
            out["holder"].append(holder[took[good]].tobytes())
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "slice" else pa.binary()) for c, v in out.items()})


def _gone(words: Ranges, ids: np.ndarray, known: np.ndarray, answers: pa.Table, window: int, anchor: int) -> np.ndarray:
    """Words of phrases that a smaller document holds."""

    def column(name, dtype):
        return np.concatenate([np.frombuffer(x, dtype) for x in answers.column(name).to_pylist()])

    h, n, place, holder = column("hash", np.uint64), column("n", np.int64), column("place", np.int64), column("holder", np.int64)
    start = np.cumsum(n) - n
    order = np.argsort(h)
    h, n, start = h[order], n[order], start[order]
    s = Stretches(Hasher(), words, window, anchor)
    mine = np.flatnonzero(known[s.of])
    key = s.hashes(mine, window)
    at = np.minimum(np.searchsorted(h, key), len(h) - 1)
    hit = h[at] == key
    mine, at = mine[hit], at[hit]
    took = spread(start[at], n[at])
    first = np.repeat(s.first[mine], n[at]) + place[took]
    first = first[holder[took] < ids[words.of[first]]]
    return covered(np.unique(first), window, len(words))
