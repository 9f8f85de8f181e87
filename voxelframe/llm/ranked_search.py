"""Ranked lexical search by NRA over impact-sorted lists.

Documents are dealt into blocks; a block is an inverted index whose lists are sorted by a term's impact in the document. A query reads its
terms' lists in parallel, from the top, without random access. A document's score is known to lie between the sum of what was read of it
and that plus the last values read from the lists in which it has not yet been seen. Documents whose upper bound falls below the k-th
largest lower bound are dropped; reading goes on until all that are left have equal bounds, so membership, ties and scores are exact.
A document lies in one block with all its terms, so the first k of a block's answers are final there, and the
first k of all blocks are the result. Queries meet blocks as in :mod:`blocks`.

Texts are read once: the words that may be a term of a query leave it, chosen by a bitmap of ``2 ** SLOT_BITS`` hash slots (a size that
doesn't grow with either table); document frequencies then come from exact strings.

Defined results: null texts and texts without a term count nowhere and match nothing; rows with the same doc_id are ranked each
by its own text; a null doc_id comes first among equal scores; of equal items (id and text) one is answered; items that share an
id are ranked each by its own text; without documents or items there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.blocks import against_blocks, number_of_blocks
from voxelframe.llm.text import NOT_ALNUM, Hasher, Ranges, map_runs, only, texts_of
from voxelframe.session import cut

TOP = 10
SLOT_BITS = 20
STEP = 64
BLOCK_ROWS, SMALL_BLOCK = 16_384, 2048
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, tie, term, times: the distinct terms of each item."""
    slim = only(items, item_id=item_id, text=text).filter("text is not null").withColumn("tie", F.xxhash64("text")).dropDuplicates(["item_id", "tie"])
    # the pattern is one of single characters, so lower case after it is the same as before
    words = slim.select("item_id", "tie", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER_CASE), F.lit(TERM), F.lit(0))).alias("term"))
    return words.groupBy("item_id", "tie", "term").agg(F.count(F.lit(1)).alias("times"))


def slot_bitmap(terms: DataFrame, bits: int = SLOT_BITS) -> np.ndarray:
    """Flags of the hash slots of these terms; at most 2 ** (bits - 6) rows come to the driver."""

    def slots(batches):
        hasher = Hasher()
        for b in batches:
            flags = np.zeros(1 << bits, bool)
            for t in texts_of(b.column(0)):
                whole = Ranges(t, t.offs[:-1], t.offs[1:])
                flags[(hasher.ranges(whole) >> np.uint64(64 - bits)).astype(np.int64)] = True
            words = np.packbits(flags, bitorder="little").view("<i8")
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_pydict({"word": at, "flags": words[at]})

    out = np.zeros(1 << (bits - 6), "<i8")
    for r in terms.select("term").distinct().mapInArrow(slots, "word long, flags long").groupBy("word").agg(F.bit_or("flags").alias("flags")).collect():
        out[r.word] = r.flags
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def postings(docs: DataFrame, wanted: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (its terms), terms, tfs: for each document its terms in these slots; and rows with n_docs: the documents with a term of a task, n all their terms."""
    shift = np.uint64(64 - int(np.log2(len(wanted))))

    def run(state, rows, t):
        hasher, totals = state
        r = t.lower().ranges(NOT_ALNUM)
        n = r.per_document()
        totals += [np.count_nonzero(n), n.sum()]
        keep = np.flatnonzero(wanted[(hasher.ranges(r) >> shift).astype(np.int64)])
        if not len(keep):
            return None
        mine = Ranges(r.texts, r.starts[keep], r.ends[keep], r.of[keep])
        place, names = mine.interned()
        key, tf = np.unique(mine.of * len(names) + place, return_counts=True)
        doc, term = np.divmod(key, len(names))
        found, count = np.unique(doc, return_counts=True)
        offs = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
        terms = names.take(pa.array(term)).cast(pa.binary()).cast(pa.string())
        return {
            "doc_id": rows.column(0).take(pa.array(found)), "n": n[found], "terms": pa.ListArray.from_arrays(offs, terms),
            "tfs": pa.ListArray.from_arrays(offs, pa.array(tf.astype(np.int64))), "n_docs": pa.nulls(len(found), pa.int64()),
        }

    def end(state):
        return {"doc_id": [None], "n": [int(state[1][1])], "terms": [None], "tfs": [None], "n_docs": [int(state[1][0])]}

    slim = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_runs(slim, "text", run, "doc_id long, n long, terms array<string>, tfs array<long>, n_docs long", lambda: (Hasher(), np.zeros(2, np.int64)), end)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int = TOP, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The k documents with the highest sums above 0 (then the smallest numbers) and their sums. A list: documents, values from the largest on."""
    low = np.zeros(n_docs, np.int64)
    seen = np.zeros((len(lists), n_docs), bool)
    live, at = np.arange(n_docs), 0
    while True:
        last = []
        for i, (docs, values) in enumerate(lists):
            d = docs[at : at + step]
            low[d] += values[at : at + step]
            seen[i, d] = True
            last.append(int(values[at + step - 1]) if at + step < len(docs) else 0)
        at, step = at + step, 2 * step
        mine = low[live]
        least = max(1, int(np.partition(mine, len(mine) - k)[len(mine) - k]) if len(mine) >= k else 0)
        high = mine + sum(last)
        for i, f in enumerate(last):
            if f:
                high -= np.where(seen[i, live], f, 0)
        keep = high >= least
        live, mine, high = live[keep], mine[keep], high[keep]
        if (mine == high).all():
            order = np.lexsort((live, -mine))[:k]
            return live[order], mine[order]


class Index:
    """Impact-sorted lists of a block of documents."""

    def __init__(self, t: pa.Table, n_all: int, l_all: int):
        t = t.sort_by([("doc_id", "ascending")])
        ids = t.column("doc_id")
        none = np.flatnonzero(pc.is_null(ids).to_numpy())  # sorted last, wanted first
        order = np.concatenate((none, np.setdiff1d(np.arange(t.num_rows), none)))
        t = t.take(pa.array(order))
        self.ids, n = t.column("doc_id").combine_chunks(), t.column("n").to_numpy()
        terms = t.column("terms").combine_chunks()
        of = np.repeat(np.arange(len(n)), terms.value_lengths().to_numpy(zero_copy_only=False))
        d = terms.flatten().dictionary_encode()
        tf = t.column("tfs").combine_chunks().flatten().to_numpy()
        if len(n) and 75 * int(n.max()) * n_all >= 2**63:
            m = np.array([25 + 75 * x * n_all // l_all for x in n.tolist()], np.int64)
        else:
            m = 25 + 75 * n * n_all // l_all
        value = 1_000_000_000 * tf // (1000 * tf + 8 * m[of])
        code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((of, -value, code))
        self.terms, self.docs, self.values = d.dictionary, of[order], value[order]
        self.begin = np.searchsorted(code[order], np.arange(len(d.dictionary) + 1))

    def search(self, terms: list[str], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        places = pc.index_in(pa.array(terms, self.terms.type), value_set=self.terms).to_pylist()
        lists = [(self.docs[lo:hi], w * self.values[lo:hi]) for p, w in zip(places, weights) if p is not None and w for lo, hi in [self.begin[p : p + 2]]]
        return nra(lists, len(self.ids), k) if lists else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP, block_rows: int = BLOCK_ROWS, small_block: int = SMALL_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 for each item, equal scores by id."""
    terms = cut(item_terms(items, item_id, item_text))
    found = cut(postings(docs, slot_bitmap(terms), doc_id, text))
    totals = found.filter("n_docs is not null").agg(F.sum("n_docs").alias("n"), F.sum("n").alias("l")).first()
    n_all, l_all = totals.n or 0, max(1, totals.l or 0)
    rows = found.filter("n_docs is null").select("doc_id", "n", "terms", "tfs")
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_all + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = terms.join(df, "term").select("item_id", "tie", "term", (F.col("times") * weight).alias("weight"))
    queries = weighted.groupBy("item_id", "tie").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    kind = queries.schema["item_id"].dataType.simpleString()

    def answer(index, queries):
        out = {"item_id": [], "tie": [], "doc_id": [], "score": []}
        for i, tie, pairs in zip(*(queries.column(c).to_pylist() for c in ("item_id", "tie", "terms"))):
            docs, scores = index.search([p["term"] for p in pairs], [p["weight"] for p in pairs], k)
            out["item_id"] += [i] * len(docs)
            out["tie"] += [tie] * len(docs)
            out["doc_id"] += index.ids.take(pa.array(docs, pa.int64())).to_pylist()
            out["score"] += scores.tolist()
        types = (queries.schema.field("item_id").type, pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(out.values(), types)], list(out))

    n = number_of_blocks(n_all, block_rows, small_block)
    # the number of a row among those of its id spreads repeated ids over the blocks
    numbered = rows.withColumn("spot", F.monotonically_increasing_id())
    best = against_blocks(numbered, queries, n, "spot", lambda t: Index(t, n_all, l_all), answer, f"item_id {kind}, tie long, doc_id long, score long")
    order = Window.partitionBy("item_id", "tie").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
