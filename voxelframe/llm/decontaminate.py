"""Benchmark decontamination: training passages as queries to a BM25 index of test items, by block-max WAND.

Every document is cut into passages of two strides, one stride apart, so any item that is no longer than a stride lies
wholly in some passage. A passage is the query; its terms' weights are those of BM25 divided by the item's score for itself, so
1 means that the passage holds all that the item holds, whatever its length. Items stand in blocks of ``BLOCK``; each term keeps
its largest weight per block. Blocks whose sum of largest weights over a passage's terms stays below the threshold can't hold
a hit: these sums are taken for many passages at once, and passages without a possible block are done. The others go
through WAND: posting lists by their current item, a pivot by the terms' largest weights, a second test by block maxima, exact
scores last. All items at or above the threshold are returned, not a top k.

A hit is kept if enough word ``GRAM``-grams of the item's question part and of its answer part stand in the passage. The answer
is what follows the last question mark or line feed, else the last third of the words.

Items of fewer than ``MIN_ITEM_WORDS`` words are too short for shares of words: a document holds one if all its words stand
there in a row, with 1 as score and overlaps. They take no part in the weights of the others.

The items are dealt into shards of about ``SHARD_WORDS`` words by a hash of their id and text; each shard is an index of its
own, small enough to travel by value, and all documents pass each shard. Document frequencies, the number and mean length of the items and the
stride are those of all items, so scores and hits don't depend on the shards.

Defined results: null texts and texts without a word match nothing; repeated documents and
items give a row each time; an empty benchmark or no documents give no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.text import NOT_ALNUM, Hasher, Texts, grams, map_runs, only, spread, texts_of, to_long
from voxelframe.session import cut

K1, B = 1.2, 0.75
MIN_SCORE = 0.6
MIN_OVERLAP = 0.5
GRAM = 3
BLOCK = 2
MIN_STRIDE = 64
MIN_ITEM_WORDS = 6
SHARD_WORDS = 500_000


def split_item(text: str) -> tuple[str, str]:
    """Question and answer part."""
    body = text.strip()
    m = re.search(r"(?s)^(.*[?\n])(.*\w.*)$", body)
    if m:
        return m[1], m[2]
    words = body.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def word_hashes(hasher: Hasher, text: str) -> np.ndarray:
    out = [to_long(hasher.ranges(t.lower().ranges(NOT_ALNUM))) for t in texts_of(pa.array([text]))]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Statistics(NamedTuple):
    """Of all items that are not short: their number, mean and largest length, and sorted term hashes with document frequencies (those of a shard will do)."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """BM25 postings of one shard with block maxima. ``items``: (id, text); without ``statistics`` the shard is all there is."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None, k1: float = K1, b: float = B, block: int = BLOCK, min_words: int = MIN_ITEM_WORDS):
        hasher = Hasher()

        def hashes(text: str) -> np.ndarray:
            return word_hashes(hasher, text)

        def gram_set(text: str) -> np.ndarray:
            h = hashes(text).view(np.uint64)
            k = min(GRAM, len(h))
            return np.unique(to_long(grams(h, np.zeros(len(h), np.int8), k)[0])) if k else np.zeros(0, np.int64)

        words = [(i, text, h) for i, text in items for h in [hashes(text or "")] if len(h)]
        short = [(i, h.view(np.uint64)) for i, _, h in words if len(h) < min_words]
        words = [x for x in words if len(x[2]) >= min_words]
        words.sort(key=lambda x: (len(x[2]), x[2][0]))
        n = len(words)
        self.ids = [i for i, _, _ in words] + [i for i, _ in short]
        # short items by number of words: sorted hashes of all their words, and the places of the items among the ids
        self.short = {}
        for k in sorted({len(h) for _, h in short}):
            place = np.array([n + i for i, (_, h) in enumerate(short) if len(h) == k])
            whole = np.array([grams(h, np.zeros(k, np.int8), k)[0][0] for _, h in short if len(h) == k])
            order = np.argsort(whole, kind="stable")
            self.short[k] = whole[order], place[order]
        self.n, self.block = n, block
        self.stride = max([MIN_STRIDE, *(len(h) for _, _, h in words), statistics.longest if statistics else 0])
        self.parts = [tuple(gram_set(x) for x in split_item(text)) for _, text, _ in words]
        self.gram_sizes = sorted({min(GRAM, len(hashes(x))) for _, text, _ in words for x in split_item(text)} - {0})
        lens = np.array([len(h) for _, _, h in words], float)
        term, item, tf = [], [], []
        for i, (_, _, h) in enumerate(words):
            t, c = np.unique(h, return_counts=True)
            term.append(t)
            item.append(np.full(len(t), i))
            tf.append(c)
        term, item, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, item, tf))
        self.terms, code, df = np.unique(term, return_inverse=True, return_counts=True)
        if not statistics:
            statistics = Statistics(n, lens.mean() if n else 1.0, 0, self.terms, df)
        every = statistics.df[np.searchsorted(statistics.terms, self.terms)]
        idf = np.log1p((statistics.n - every + 0.5) / (every + 0.5))
        weight = idf[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[item] / statistics.mean)) if n else np.zeros(0)
        own = np.bincount(item, weight, n)
        weight = weight / own[item]
        order = np.lexsort((item, code))
        self.item, self.weight = item[order], weight[order]
        self.begin = np.concatenate(([0], np.cumsum(df)))
        self.top = np.maximum.reduceat(self.weight, self.begin[:-1]) if n else np.zeros(0)
        # block maxima as postings of (term, block)
        key = code[order] * (n // block + 1) + self.item // block
        first = np.flatnonzero(np.diff(key, prepend=-1)) if n else np.zeros(0, np.int64)
        self.block_max = np.maximum.reduceat(self.weight, first) if n else np.zeros(0)
        self.block_no = (self.item // block)[first]
        self.block_begin = np.concatenate(([0], np.cumsum(np.bincount(code[order][first], minlength=len(df))))) if n else np.zeros(1, np.int64)
        self.n_blocks = -(-n // block)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Places of word hashes among the terms, -1 for others."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def block_bounds(self, term: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
        """Upper bounds of scores, passages by blocks, for distinct (term, passage)."""
        lens = self.block_begin[term + 1] - self.block_begin[term]
        at = spread(self.block_begin[term], lens)
        return np.bincount(np.repeat(passage, lens) * self.n_blocks + self.block_no[at], self.block_max[at], n * self.n_blocks).reshape(n, self.n_blocks)

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least ``least``."""
        lists = [[self.begin[t], self.begin[t + 1], t] for t in terms]
        item, weight, out = self.item, self.weight, []
        eps = least - 1e-9
        while lists:
            lists.sort(key=lambda x: item[x[0]])
            bound = 0.0
            for p, (_, _, t) in enumerate(lists):
                bound += self.top[t]
                if bound >= eps:
                    break
            else:
                break
            pivot = item[lists[p][0]]
            while p + 1 < len(lists) and item[lists[p + 1][0]] == pivot:
                p += 1
            block = pivot // self.block
            if self._block_bound([t for _, _, t in lists[: p + 1]], block) < eps:
                # no item from here to the end of the block, or to the next list's item, can reach the threshold
                target = (block + 1) * self.block
                if p + 1 < len(lists):
                    target = min(target, item[lists[p + 1][0]])
                target = max(target, pivot + 1)
            else:
                if item[lists[0][0]] == pivot:
                    s = float(sum(weight[x[0]] for x in lists[: p + 1]))
                    if s >= eps:
                        out.append((int(pivot), s))
                    target = pivot + 1
                else:
                    target = pivot
            for x in lists[: p + 1]:
                if item[x[0]] < target:
                    x[0] += np.searchsorted(item[x[0] : x[1]], target)
            lists = [x for x in lists if x[0] < x[1]]
        return out

    def _block_bound(self, terms: list[int], block: int) -> float:
        s = 0.0
        for t in terms:
            lo, hi = self.block_begin[t], self.block_begin[t + 1]
            at = lo + np.searchsorted(self.block_no[lo:hi], block)
            if at < hi and self.block_no[at] == block:
                s += self.block_max[at]
        return s


def passages(index: Index, h: np.ndarray, bounds: np.ndarray, least: float):
    """(first word, last word + 1, items and scores) of the passages with hits; ``bounds`` are those of documents."""
    code = index.codes(h)
    n_words = np.diff(bounds)
    strides = np.maximum(1, -(-n_words // index.stride) - 1) * (n_words > 0)
    doc = np.repeat(np.arange(len(n_words)), strides)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(strides) - strides, strides)
    lo = bounds[:-1][doc] + number * index.stride
    hi = np.minimum(lo + 2 * index.stride, bounds[1:][doc])
    known = np.flatnonzero(code >= 0)
    a, b = np.searchsorted(known, lo), np.searchsorted(known, hi)
    step = max(1, 4_000_000 // max(1, index.n_blocks))
    for p in range(0, len(lo), step):
        q = min(len(lo), p + step)
        words = known[spread(a[p:q], b[p:q] - a[p:q])]
        key = np.unique(np.repeat(np.arange(q - p), b[p:q] - a[p:q]) * len(index.terms) + code[words])
        of, term = np.divmod(key, max(1, len(index.terms)))
        top = np.bincount(of, index.top[term], q - p) >= least - 1e-9
        live = np.flatnonzero(top)
        if not len(live):
            continue
        mine = top[of]
        of, term = of[mine], term[mine]
        bounds_ = index.block_bounds(term, np.searchsorted(live, of), len(live))
        for i in live[bounds_.max(axis=1) >= least - 1e-9].tolist():
            x, y = np.searchsorted(of, [i, i + 1])
            found = index.wand(term[x:y].tolist(), least)
            if found:
                yield int(doc[p + i]), int(lo[p + i]), int(hi[p + i]), found


def short_items(index: Index, h: np.ndarray, of: np.ndarray):
    """(document, item) of the short items whose words stand in a row in a document; ``of`` is the document of each word."""
    for k, (whole, place) in index.short.items():
        g, first = grams(h, of, k)
        lo = np.searchsorted(whole, g)
        lens = np.searchsorted(whole, g, "right") - lo
        yield from set(zip(np.repeat(of[first], lens).tolist(), place[spread(lo, lens)].tolist()))


def overlaps(index: Index, item: int, h: np.ndarray) -> tuple[float, float]:
    """Shares of the grams of the item's question and answer part that stand among these words."""
    out = []
    for part in index.parts[item]:
        if not len(part):
            out.append(1.0)
            continue
        best = 0.0
        for k in index.gram_sizes:
            if k <= len(h):
                mine = to_long(grams(h, np.zeros(len(h), np.int8), k)[0])
                best = max(best, float(np.isin(part, mine).mean()))
        out.append(best)
    return out[0], out[1]


def shards(items: DataFrame, item_id: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS, min_words: int = MIN_ITEM_WORDS):
    """(items, statistics) for :class:`Index`, each of about ``shard_words`` words."""
    slim = only(items, item_id=item_id, text=text).filter("text is not null")

    def words(hasher, rows, t):
        r = t.lower().ranges(NOT_ALNUM)
        h, n = to_long(hasher.ranges(r)), r.per_document()
        parts = [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
        offs = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return {"item_id": rows.column(0), "text": rows.column(1), "n_words": n, "terms": pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(parts)))}

    found = cut(map_runs(slim, "text", words, f"item_id {slim.schema['item_id'].dataType.simpleString()}, text string, n_words long, terms array<long>", Hasher))
    total = found.agg(F.sum("n_words")).first()[0] or 0
    whole = found.filter(F.col("n_words") >= min_words)
    n, mean, longest = whole.agg(F.count(F.lit(1)), F.avg("n_words"), F.max("n_words")).first()
    df = cut(whole.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n_shards = -(-total // shard_words)
    for i in range(n_shards):
        # at most about shard_words words: the bound of what goes to the driver and the tasks
        part = found.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)) == i)
        mine = part.select(F.explode("terms").alias("term")).distinct().join(df, "term").orderBy("term").toArrow()
        yield [(r.item_id, r.text) for r in part.select("item_id", "text").collect()], Statistics(n, mean or 1.0, longest or 0, mine["term"].to_numpy(), mine["df"].to_numpy())


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the best passage of each contaminated (document, item)."""
    slim = only(docs, doc_id=doc_id, text=text)
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for shard in shards(items, item_id, item_text, shard_words):
        out = out.unionByName(map_runs(slim, "text", _hits(shard, min_score, min_overlap), schema, lambda shard=shard: (Hasher(), Index(*shard))))
    return out


def _found(state, t: Texts, min_score: float, min_overlap: float) -> dict[tuple[int, int], tuple]:
    """(document, item) -> best (score, question overlap, answer overlap)."""
    hasher, index = state
    best: dict[tuple[int, int], tuple] = {}
    if not index.ids:
        return best
    r = t.lower().ranges(NOT_ALNUM)
    h = hasher.ranges(r)
    for at in short_items(index, h, r.of):
        best[at] = (1.0, 1.0, 1.0)
    if not index.n:
        return best
    for d, lo, hi, found in passages(index, to_long(h), r.bounds(), min_score):
        for item, s in found:
            q, a = overlaps(index, item, h[lo:hi])
            if q >= min_overlap and a >= min_overlap:
                best[d, item] = max(best.get((d, item), ()), (s, q, a))
    return best


def _hits(shard, min_score, min_overlap):
    def run(state, rows, t):
        best = sorted(_found(state, t, min_score, min_overlap).items())
        if best:
            at = pa.array([d for (d, _), _ in best])
            s, q, a = zip(*(v for _, v in best))
            return {"doc_id": rows.column(0).take(at), "item_id": [state[1].ids[i] for (_, i), _ in best], "score": s, "question_overlap": q, "answer_overlap": a}

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of the table, all columns as they are, that hold no item."""
    names, fields = [f"c{i}" for i in range(len(docs.columns))], docs.schema.fields
    body = names[docs.columns.index(text)]
    out = docs.toDF(*names)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields))

    def keep(state, rows, t):
        bad = {d for d, _ in _found(state, t, min_score, min_overlap)}
        good = [i for i in range(len(t)) if i not in bad]
        if good:
            kept = rows.take(pa.array(good))
            return {n: kept.column(i) for i, n in enumerate(names)}

    for shard in shards(items, item_id, item_text, shard_words):
        out = map_runs(out, body, keep, schema, lambda shard=shard: (Hasher(), Index(*shard)))
    return out.toDF(*docs.columns)
