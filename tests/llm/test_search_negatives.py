"""Bit-sliced SimHash, hard negatives and NRA search against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import LOWER, SCHEMA, prose, rows_by_id
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from voxelframe.llm import hard_negatives, ranked_search, simhash
from voxelframe.llm import text as T
from voxelframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text, width=3):
    words = WORD.findall((text or "").encode().translate(LOWER))
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius):
    """For each row of (id, fingerprint): the smallest id that links reach."""
    seen, out = set(), {}
    for start in range(len(fps)):
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in range(len(fps)):
                if y not in group and (fps[x][1] ^ fps[y][1]).bit_count() <= radius:
                    group.add(y)
                    todo.append(y)
        seen |= group
        ids = [fps[x][0] for x in group if fps[x][0] is not None]
        out |= {x: min(ids, default=None) for x in group}
    return [out[x] for x in range(len(fps))]


def check_components(got, rows, radius=3):
    fps = [(i, fingerprint(t)) for i, t in rows]
    want = [(str(i), f, str(c)) for (i, f), c in zip(fps, linked(fps, radius))]
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == sorted(want)


def clouds(seed, centres, most):
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        x = r.getrandbits(64)
        out |= {x ^ sum({1 << r.randrange(64) for _ in range(r.randrange(5))}) for _ in range(r.randint(1, most))}
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_bit_sliced_pairs(radius):
    fp = clouds(1, 12, 60)
    ends = np.where(np.arange(len(fp)) < len(fp) // 3, len(fp) // 3, len(fp))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, ends[i]) if int(fp[i] ^ fp[j]).bit_count() <= radius}
    got = [(int(i), int(j)) for a, b in simhash.close_pairs(fp, ends, radius, step=97) for i, j in zip(a, b)]
    assert len(got) == len(want) and set(got) == want


def test_majority_of_long_texts():
    h = np.random.default_rng(2).integers(0, 2**64, 200_001, dtype=np.uint64)
    h[:150_000] |= np.uint64(1 << 63 | 1)
    of = np.repeat([1, 3], [200_000, 1])
    want = [0, 0, 0, int(h[-1])]
    for b in range(64):
        want[1] |= int(2 * int((h[:200_000] >> np.uint64(b) & np.uint64(1)).sum()) > 200_000) << b
    assert simhash.majority(h, of, 4).tolist() == want


def test_masks_never_lose_a_pair():
    """Two values at most three bits apart agree on some mask of every level."""
    r = random.Random(3)
    masks = [0]
    for _ in range(simhash.LEVELS):
        masks = sorted({c for m in masks for c in simhash.submasks(m)})
        for _ in range(300):
            d = sum({1 << r.randrange(64) for _ in range(3)})
            assert any(not d & m for m in masks)
    assert max(64 - m.bit_count() for m in masks) <= 16


@pytest.mark.parametrize("limit", [2048, 8, 1])
def test_links_through_full_cells(spark, limit):
    """Cells of any size, a cloud of near values that holds most of the rows among them."""
    fp = np.unique(np.concatenate((clouds(4, 6, 25), clouds(5, 1, 400))))
    signed = fp.view(np.int64).tolist()
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, node long")
    got = simhash.links(nodes, limit=limit).collect()
    assert all(int(fp[a] ^ fp[b]).bit_count() <= 64 for a, b in got)
    root = simhash.roots(len(fp), iter([(np.array([r.src for r in got]), np.array([r.dst for r in got]))]))
    assert root.tolist() == linked([(i, int(x)) for i, x in enumerate(fp)], 3)


def test_simhash_components(spark, awkward, nothing):
    check_components(simhash.components(awkward).collect(), [(r.doc_id, r.text) for r in awkward.collect()])
    assert simhash.components(nothing).collect() == []


def test_simhash_of_copies(spark):
    """Exact copies in most rows, near copies of long texts, and texts without words."""
    base = prose(6, 900)
    near = [" ".join(w if k != 40 * i else "changed" for k, w in enumerate(base.split())) for i in range(8)]
    rows = [(100 + i, base) for i in range(60)] + [(i, t) for i, t in enumerate(near)] + [(300 + i, prose(70 + i, 60)) for i in range(20)] + [(401, ""), (402, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_components(simhash.components(docs, limit=4).collect(), rows)


def test_simhash_query(spark):
    rows = rows_by_id(spark, FOLDER)
    got = QUERIES["op11_bit_sliced_simhash"](spark, FOLDER).collect()
    fps = [(i, fingerprint(t)) for i, t in rows]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, linked(fps, 3))]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(want)


VECTORS = "vec_id long, embedding array<double>, label long, score long, vec string, rank int"


def negatives(rows, anchor, n_pos=5, n_neg=5):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        while q and not q[-1]:
            q.pop()
        best[i] = min(best.get(i, (label, q)), (label, q), key=lambda x: x[0])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, va) in best.items():
        if not anchor(a):
            continue
        others = sorted((-dot(va, v), i, label) for i, (label, v) in best.items() if i != a)
        for s, p, _ in [x for x in others if x[2] == la][:n_pos]:
            found = [(t, n) for t, n, label in others if label != la and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(found[:n_neg])]
    return sorted(out)


def vectors(seed, n, labels=4, d=20, spread=0.2):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(3)]
    return [(i, [c + r.gauss(0, spread) for c in r.choice(centres)], r.randrange(labels)) for i in range(n)]


def test_hard_negatives(spark):
    rows = vectors(1, 500)
    rows[10:60] = [(i, rows[0][1], 2) for i in range(10, 60)]  # ties
    rows += [(None, rows[0][1], 1), (900, None, 1), (901, rows[1][1], None), (902, [1.0, None], 1), (903, [math.nan] * 20, 1), (904, [math.inf], 0), (910, [], 1), (920, [0.5], 2), (930, [0.1] * 33, 0), (940, [-5.0] * 20, 99)]
    rows += [(7, rows[7][1], rows[7][2])] * 3
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)
    want = negatives(rows, lambda a: a % 10 == 0)
    assert want
    for size in (10_000, 40):
        got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, block_rows=size, small_block=size).collect()
        assert sorted(map(tuple, got)) == want
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_one_label_holds_most_rows(spark):
    rows = [(i, v, 0 if i % 7 else label) for i, v, label in vectors(2, 400, d=8, spread=0.6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = hard_negatives.mine(table, F.col("vec_id") % 25 == 0, block_rows=30, small_block=30).collect()
    assert sorted(map(tuple, got)) == negatives(rows, lambda a: a % 25 == 0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 20))
def test_segment_bounds_hold(seed, d, segments):
    r = np.random.default_rng(seed)
    x, y = r.integers(-900, 900, (2, 15, d)).astype(float)
    (m, s), (m2, s2) = (hard_negatives.summaries(v, segments) for v in (x, y))
    exact = x @ y.T
    assert (np.abs(exact - m @ m2.T) <= s @ s2.T + 1e-6).all()
    if segments >= d:
        assert np.allclose(exact, m @ m2.T)


def test_summaries_drop_rows():
    """Rows far from the range never reach the exact score."""
    r = np.random.default_rng(5)
    x = np.concatenate((r.integers(200, 260, (50, 32)), r.integers(-260, -200, (3000, 32))))
    t = pa.table({"vec_id": np.arange(len(x)), "label": np.zeros(len(x), np.int64), "vec": pa.array([v.astype("<i4").tobytes() for v in x], pa.binary())})
    block, scored = hard_negatives.Block(t), []
    exact = block.scores
    block.scores = lambda at, q: scored.append(len(at)) or exact(at, q)
    ((ids, s),) = block.first(x[0].astype(float), [(0, len(x))], [(0, np.inf)], 5, 0)
    want = sorted((-int(v @ x[0]), i) for i, v in enumerate(x) if i)[:5]
    assert list(zip((-s).tolist(), ids.tolist())) == want and sum(scored) <= 49


def test_scores_beyond_doubles():
    v = np.array([[2**31 - 1, 3], [-(2**31) + 1, 5]])
    t = pa.table({"vec_id": [1, 2], "label": [0, 0], "vec": pa.array([x.astype("<i4").tobytes() for x in v], pa.binary())})
    block = hard_negatives.Block(t)
    assert block.scores(np.arange(2), v[0].astype(float)).tolist() == [(2**31 - 1) ** 2 + 9, -((2**31 - 1) ** 2) + 15]


TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").encode().translate(LOWER))


def ranked(docs, items, k=10):
    bags = [(i, terms_of(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_all, l_all = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in set(items):
        found = []
        for i, b in bags:
            m = 25 + 75 * len(b) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (10**9 * b.count(w) // (1000 * b.count(w) + 8 * m)) for w in terms_of(text) if w in df)
            if s > 0:
                found.append((-s, (i is not None, i or 0), i))
        out += [(str(item), r + 1, str(i), -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def rows(df):
    return sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in df.collect())


ITEMS = "item_id long, text string, score long, terms string, n long"


def test_ranked_search(spark, awkward, nothing):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    some = [x for _, x in docs if x]
    items = [(1, some[0][:200]), (1, some[0][:200]), (1, "Spam one"), (2, None), (3, ""), (4, "zzz unknown words"), (None, "one TWO x x x"), (5, "日本語 éè"), (6, some[-1])]
    bench = spark.createDataFrame([(*x, 1, "t", 2) for x in items], ITEMS)
    want = ranked(docs, items)
    assert want
    for size in (10_000, 3):
        assert rows(ranked_search.search(awkward, bench, block_rows=size, small_block=size)) == want
    assert ranked_search.search(nothing, bench).collect() == []
    assert ranked_search.search(awkward, bench.limit(0)).collect() == []


def test_ties_in_copies(spark):
    """Copies tie: the smallest ids win, over all blocks."""
    text = prose(11, 50)
    docs = [(1000 - i, text if i % 3 else prose(200 + i, 50)) for i in range(120)]
    items = [(1, text[:60]), (2, prose(203, 20))]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), block_rows=7, small_block=7)
    assert rows(got) == ranked(docs, items)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 9), max_size=31), min_size=1, max_size=6), st.integers(1, 12), st.integers(1, 5))
def test_nra_is_exact(entries, k, step):
    lists = []
    for e in entries:
        pairs = sorted(e.items(), key=lambda x: (-x[1], x[0]))
        lists.append((np.array([d for d, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int64)))
    total = {}
    for e in entries:
        for d, v in e.items():
            total[d] = total.get(d, 0) + v
    want = sorted((-v, d) for d, v in total.items())[:k]
    docs, scores = ranked_search.nra(lists, 31, k, step)
    assert list(zip((-scores).tolist(), docs.tolist())) == want


def test_nra_stops_early():
    """A clear winner ends the reading long before the lists do."""
    n = 100_000
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop)
            return super().__getitem__(key)

    docs = np.arange(n)
    values = np.maximum(1, 10_000 - 9 * docs)
    lists = [(docs.view(Counted), values), (docs, values)]
    assert ranked_search.nra(lists, n, 3)[0].tolist() == [0, 1, 2]
    assert max(reads) < 1000


def test_slots_hold_all_terms(spark):
    terms = spark.createDataFrame([(f"w{i}",) for i in range(3000)] + [("日本",)], "term string").repartition(3)
    flags = ranked_search.slot_bitmap(terms, 12)
    assert len(flags) == 4096
    t = next(T.texts_of(pa.array([" ".join(f"w{i}" for i in range(3000)) + " 日本"])))
    h = T.Hasher().ranges(t.words())
    assert flags[(h >> np.uint64(52)).astype(int)].all()


def test_schema_of_clashing_names(awkward):
    assert awkward.schema.simpleString().count(":") == SCHEMA.count(",") + 1
