"""Similarity join, line winnowing and phrase removal against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import LOWER, prose, rows_by_id

from voxelframe.llm import jaccard, phrases, winnow
from voxelframe.llm.text import Hasher, texts_of

FOLDER = "/root/testdata/sf0.001"


def shingles(text, width):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, percent, width):
    """doc_id -> (set size, smallest id reachable); rows without an id link like others."""
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted((str(d), len(s), str(low.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def found_components(df, percent, width):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.components(df, percent=percent, width=width).collect())


def edits(words, n, r, alphabet="xyz"):
    words = list(words)
    for _ in range(n):
        i = r.randrange(len(words))
        kind = r.choice("idr")
        if kind == "i":
            words.insert(i, r.choice(alphabet) + str(r.random()))
        elif kind == "d" and len(words) > 1:
            del words[i]
        else:
            words[i] = r.choice(alphabet) + str(r.random())
    return words


@pytest.mark.parametrize(("percent", "width"), [(85, 4), (80, 5)])
def test_components_equal_brute_force(spark, percent, width):
    """Chains and clusters of near copies of all sizes, around the threshold; a passage that all documents hold."""
    r = random.Random(5)
    texts, passage = [], prose(77, 60)
    for size in (2, 5, 9, 10, 11, 13, 16, 20, 30, 47, 80, 150, 400):
        base = prose(size, size).split()
        for _ in range(5):
            texts.append(" ".join(edits(base, r.randint(0, max(1, size // 40)), r)))
        step = base
        for _ in range(5):
            step = edits(step, max(1, size // 60), r)
            texts.append(" ".join(step))
    texts += [prose(500 + i, 60) + " " + passage for i in range(30)]
    texts += ["", None, "a", "A", "a b c", "a  B\tc"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found_components(df, percent, width) == brute_components(rows, percent, width)


def test_components_of_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found_components(awkward, 85, 4) == brute_components(rows, 85, 4)
    assert jaccard.components(nothing).collect() == []


def test_cells_find_links_that_stars_miss(spark, monkeypatch):
    """A star's centre need not be linked to members that are linked to each other; cells of two find them."""
    monkeypatch.setattr(jaccard, "CELL", 2)
    r = random.Random(3)
    base = prose(8, 240).split()
    rows = [(i, " ".join(edits(base, 6, r))) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_components(df, 85, 4) == brute_components(rows, 85, 4)


def test_tiles_hold_every_link():
    """Pairs of sets at any distance within the threshold meet in a tile; distant ones that share a part of the text don't."""
    r = np.random.default_rng(2)
    for percent in (80, 85, 95):
        bands = jaccard.Bands(percent)
        for n in [*range(1, 60), 100, 333, 1000]:
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = 0
            while 100 * (n - drop - 1) >= percent * n:
                drop += 1
            add = 0
            while 100 * n >= percent * (n + add + 1):
                add += 1
            for b in (a[: n - drop], np.sort(np.concatenate((a, r.integers(0, 2**63, add).astype(np.uint64))))):
                g = np.concatenate((a, b))
                key, doc = jaccard.tile_keys(g, np.array([0, len(a), len(g)]), bands)
                assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist()) or len(a) == len(b) == n and n < 2 or (a == b).all()
    shared = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
    one, two = (np.unique(np.concatenate((shared, r.integers(0, 2**63, 400).astype(np.uint64)))) for _ in range(2))
    key, doc = jaccard.tile_keys(np.concatenate((one, two)), np.array([0, len(one), len(one) + len(two)]), bands := jaccard.Bands(85))
    assert len(set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())) <= 2 and bands.low[0] == 12


def test_signature_bounds_overlap():
    r = np.random.default_rng(1)
    for n, m, common in ((5, 9, 3), (100, 90, 80), (1000, 300, 300), (70, 4000, 10)):
        pool = np.unique(r.integers(0, 2**63, n + m).astype(np.uint64))
        r.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[n - common : n - common + m])
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        w = min(len(x), len(y))
        assert jaccard.overlap(a, b) == len(set(a.tolist()) & set(b.tolist())) <= int(jaccard.room(jaccard.folded(x, w), jaccard.folded(y, w), len(a), len(b)))


def test_one_of_each_group(awkward):
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 12, 13, 14, 15, 16] and ids.count(None) == 2


def test_one_row_of_each_component_of_a_repeated_id(spark):
    a, b, c, d = (prose(900 + i, 80) for i in range(4))
    near = " ".join([*d.split()[:-1], "changed"])
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, near), (3, c), (4, b), (5, d), (6, ""), (6, prose(990, 9)), (7, None), (7, "")]
    df = spark.createDataFrame([(x, t, "e") for x, t in rows], "doc_id long, text string, component string").repartition(4)
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()]
    assert sorted(x for x, _ in kept) == [1, 2, 3, 3, 6, 6, 7]
    assert {(1, a), (2, b), (3, c), (6, ""), (6, prose(990, 9))} < set(kept) and len({(3, d), (3, near)} & set(kept)) == 1


def brute_lines(rows, run=winnow.RUN, min_words=winnow.MIN_WORDS):
    """(id, text) rows in order -> text left, lines, removed: repeats of ``run`` lines, and of fewer with enough words."""
    seen, out = {}, {}
    order = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0))

    def runs(full):
        for p in range(len(full)):
            for k in range(1, run + 1):
                lines = tuple(full[p : p + k])
                if len(lines) == k and (k == run or min_words is not None and len(b" ".join(lines).split()) >= min_words):
                    yield p, lines

    for d, text in order:
        for p, lines in runs([x for x in (text or "").encode().split(b"\n") if x.split()]):
            seen.setdefault(lines, (d, p))
    for d, text in order:
        lines = (text or "").encode().split(b"\n")
        full = [i for i, x in enumerate(lines) if x.split()]
        gone = {full[p + j] for p, found in runs([lines[i] for i in full]) if seen[found] != (d, p) for j in range(len(found))}
        left = b"\n".join(x for i, x in enumerate(lines) if i not in gone) if len(gone) < len(full) else b""
        out[d, text] = (left if gone else (text or "").encode(), len(full), len(gone))
    return out


def test_line_runs_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice("abcdefg") + " line" if r.random() < 0.8 else " " for _ in range(r.randint(0, 25)))) for i in range(60)]
    df = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, lines string").repartition(5)
    for run in (1, 2, 3, 4):
        got = {(x.doc_id): (x.text.encode(), x.n_lines, x.n_removed) for x in winnow.dedup_lines(df, run=run, min_words=None, counts=True).collect()}
        assert got == {d: v for (d, _), v in brute_lines(rows, run, None).items()}


def test_lines_of_awkward_rows(awkward, nothing):
    got = winnow.dedup_lines(awkward, counts=True)
    want = brute_lines([(r.doc_id, r.text) for r in awkward.collect()])
    rows = got.collect()
    assert len(rows) == awkward.count() and got.columns == [*awkward.columns, "n_lines", "n_removed"]
    assert all(((x.text or "").encode(), x[-2], x[-1]) == want[x.doc_id, t] for x in rows if x.doc_id is not None for t in [o.text for o in awkward.collect() if o.doc_id == x.doc_id][:1])
    assert next(x for x in rows if x.doc_id == 4).text in (None, "")
    left = winnow.dedup_lines(awkward, drop_emptied=True)
    assert left.columns == awkward.columns and 11 not in [x.doc_id for x in left.collect()] and 4 in [x.doc_id for x in left.collect()]
    assert winnow.dedup_lines(nothing).collect() == []


def test_long_lines_go_in_runs_of_any_number(spark):
    r = random.Random(9)
    pool = [prose(700 + i, n) for i, n in enumerate((1, 3, 6, 7, 12, 13, 14, 40))]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.6 else prose(5000 + 40 * i + k, r.randint(1, 20)) for k in range(r.randint(0, 9)))) for i in range(80)]
    rows += [(100, pool[7]), (101, pool[7]), (102, pool[0]), (103, None), (104, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for run in (2, 3, 4):
        got = {x.doc_id: ((x.text or "").encode(), x.n_lines, x.n_removed) for x in winnow.dedup_lines(df, run=run, counts=True).collect()}
        assert got == {d: v for (d, _), v in brute_lines(rows, run).items()}
        assert got[101] == (b"", 1, 1) and got[102] == (pool[0].encode(), 1, 0)


def test_one_line_in_most_documents(spark):
    """A long line and a run that nearly all documents hold: only the first place stays."""
    line, block = prose(31, 20), "\n".join(prose(32 + i, 3) for i in range(3))
    rows = [(i, f"{prose(9000 + i, 9)}\n{line}\n{prose(9500 + i, 9)}\n{block}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: (x.text.encode(), x.n_lines, x.n_removed) for x in winnow.dedup_lines(df, counts=True).collect()}
    assert got == {d: v for (d, _), v in brute_lines(rows).items()} and {v[2] for v in got.values()} == {0, 4}


def brute_phrases(rows, window):
    first, out = {}, {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(d, first.get(g, d))
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.setdefault(d, []).append((len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return {d: sorted(v) for d, v in out.items()}


def found_phrases(df, **settings):
    out = {}
    for r in phrases.remove_repeats(df, **settings).collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256, r.kept))
    return {d: sorted(v) for d, v in out.items()}


def test_phrases_equal_brute_force(spark):
    r = random.Random(6)
    pool = [prose(600 + i, r.randint(13, 40)) for i in range(6)]
    rows = [(i, " ".join(r.choice([r.choice(pool), prose(1000 + i * 7 + k, 15), "a b a b a b a b a b a b a b a b"]) for k in range(r.randint(0, 5)))) for i in range(60)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found_phrases(df) == brute_phrases(rows, 13)
    assert found_phrases(df, window=6, anchor=3) == brute_phrases(rows, 6)


def test_phrases_of_awkward_rows(awkward, nothing):
    assert found_phrases(awkward) == brute_phrases([(r.doc_id, r.text) for r in awkward.collect()], 13)
    assert phrases.remove_repeats(nothing).collect() == []


def test_automaton_locates_confirmed_phrases_only():
    s = [b"a b c d e", b"x b c d y", b"q r s"]
    got = phrases.locate(s, np.array([1, 2, 3]), np.array([1, 2, 9]), 3)
    assert [x.tolist() for x in got] == [[1, 1, 1], [1, 1, 0], [1, 1, 3]]


def test_queries_on_the_small_tables(spark):
    from voxelframe.llm.queries import QUERIES

    rows = rows_by_id(spark, FOLDER)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_phrase_automata"](spark, FOLDER).collect()}
    assert got == {d: v[0][:3] for d, v in brute_phrases(rows, 13).items()}
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in QUERIES["op8_ngram_jaccard_join"](spark, FOLDER).collect())
    assert found == brute_components(rows, 85, 4)


def test_sets_of_runs_don_t_depend_on_the_cut():
    texts = pa.array(["a b c d e", "", "A b", None, "a b c d e", "z " * 40])
    for size in (3, 1 << 20):
        out = []
        for t in texts_of(texts, size):
            g, b = jaccard.sets_of(Hasher(), t)
            out += [tuple(x.tolist()) for x in np.split(g, b[1:-1])]
        if size == 3:
            want = out
    assert out == want and len(out) == 6 and len(out[5]) == 1
