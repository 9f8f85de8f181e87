"""Quality rules, decontamination, licence scans, toxicity and archives against brute force and exact round trips."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from conftest_llm import LOWER, prose, rows_by_id
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.check import duck, rows_of
from voxelframe.llm import decontaminate, divergence, licences, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def alnum(text):
    return re.findall(WORD, (text or "").encode().translate(LOWER))


@pytest.mark.parametrize("name", ["op1_distribution_divergence", "op9_line_winnowing"])
def test_query_equals_twin(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    con = duck(FOLDER)
    con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, con.fetchall())


def brute_base(text):
    text = text or ""
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_base_rules_of_awkward_rows(awkward, nothing):
    got = {}
    for r in divergence.quality(awkward).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
        assert r.kept <= (not r.base_failed) and r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    want = {}
    for r in awkward.collect():
        if not r.text or len(r.text) < 50_000:
            want.setdefault(r.doc_id, []).append(brute_base(r.text))
    assert {d: sorted(v) for d, v in got.items() if d != 12} == {d: sorted(v) for d, v in want.items()}
    assert divergence.quality(nothing).collect() == [] and divergence.keep_good(nothing).collect() == []


def test_divergent_documents_go_and_columns_stay(spark):
    good = [(i, prose(i, 200), "en", i) for i in range(60)]
    words = good[0][1].split()
    bad = [(100, " ".join(w + "###" for w in words), "en", 0), (101, "| ".join(prose(5, 200, 150).upper().split()), "en", 0)]
    df = spark.createDataFrame(good + bad + [(102, "short ### text ### of ### ten ### words ### here ###", "en", 0)], "doc_id long, text string, lang string, kept long")
    kept = divergence.keep_good(df)
    assert kept.columns == df.columns
    # by its length the last is judged by the base rules alone
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 102]


def test_js_distance():
    p, q = np.array([[1.0, 0.0], [5.0, 5.0], [3.0, 1.0]]), np.array([0.0, 1.0])
    assert divergence.js_distance(p, q)[0] == 1 and divergence.js_distance(p, np.array([0.5, 0.5]))[1] == 0
    m = [(0.75 + 0.25) / 2, (0.25 + 0.75) / 2]
    want = sum(a * math.log2(a / b) for a, b in zip([0.75, 0.25], m)) / 2 + sum(a * math.log2(a / b) for a, b in zip([0.25, 0.75], m)) / 2
    assert math.isclose(divergence.js_distance(p, np.array([0.25, 0.75]))[2], math.sqrt(want))


def brute_scores(items, words):
    """BM25 of every item for the set of words, as shares of the items' own scores."""
    bags = [alnum(t) for _, t in items]
    n, mean = len(bags), sum(map(len, bags)) / len(bags)
    df = {w: sum(w in b for b in bags) for b in bags for w in b}

    def score(bag, query):
        return sum(
            math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * bag.count(w) * (decontaminate.K1 + 1)
            / (bag.count(w) + decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(bag) / mean))
            for w in set(query) & set(bag)
        )

    return [score(b, words) / score(b, b) for b in bags]


@pytest.mark.parametrize("least", [0.15, 0.3, 0.6])
def test_wand_returns_all_above_the_threshold(least):
    r = random.Random(int(100 * least))
    items = [(i, prose(2000 + i, r.randint(6, 50), 60 + 10 * i)) for i in range(40)] + [(40, "the same item twice with words"), (41, "the same item twice with words")]
    index = decontaminate.Index(items)
    from voxelframe.llm.text import Hasher, texts_of, NOT_ALNUM, to_long
    import pyarrow as pa

    hits = 0
    for i in range(60):
        text = " ".join(r.sample(" ".join(t for _, t in items).split(), 50)) + " " + " ".join(r.choice(items)[1].split()[: r.randint(0, 40)])
        t = next(texts_of(pa.array([text])))
        codes = np.unique(index.codes(to_long(Hasher().ranges(t.lower().ranges(NOT_ALNUM)))))
        codes = codes[codes >= 0]
        got = {index.ids[k]: s for k, s in index.wand(codes.tolist(), least)}
        want = {i: s for (i, _), s in zip(items, brute_scores(items, alnum(text))) if s >= least}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
        bound = index.block_bounds(codes, np.zeros(len(codes), int), 1)[0]
        place = {x: k for k, x in enumerate(index.ids)}
        assert all(bound[place[k] // index.block] >= s - 1e-9 for k, s in got.items())
        hits += len(got)
    assert hits


def brute_contaminated(rows, items):
    """Ids of the documents with a passage of enough score and overlap, over all items of six words or more."""
    bags = {i: alnum(t) for i, t in items}
    stride = max([decontaminate.MIN_STRIDE, *map(len, bags.values())])

    def grams(words):
        return {tuple(words[p : p + k]) for k in (1, 2, 3) for p in range(len(words) - k + 1)}

    def share(part, have):
        k = min(decontaminate.GRAM, len(part))
        own = {tuple(part[p : p + k]) for p in range(len(part) - k + 1)} if k else set()
        return len(own & have) / len(own) if own else 1

    bad = set()
    for d, text in rows:
        words = alnum(text)
        for j in range(max(1, -(-len(words) // stride) - 1) if words else 0):
            passage = words[j * stride : (j + 2) * stride]
            have = grams(passage)
            for (_, item), s in zip(items, brute_scores(items, passage)):
                if s >= decontaminate.MIN_SCORE and min(share(alnum(x), have) for x in decontaminate.split_item(item)) >= decontaminate.MIN_OVERLAP:
                    bad.add(d)
    return bad


def test_scores_dont_depend_on_shards(spark):
    """Partial copies, whose scores follow the weights of their terms."""
    r = random.Random(12)
    items = [(i, prose(3100 + i % 7, r.randint(8, 60), 70)) for i in range(40)]
    docs = [(i, prose(8000 + i, 40) + " " + " ".join(items[i % 40][1].split()[: r.randint(5, 60)])) for i in range(120)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    total = sum(len(t.split()) for _, t in items)
    got = [sorted((x.doc_id, x.item_id, round(x.score, 9)) for x in decontaminate.search(df, bench, shard_words=-(-total // n)).collect()) for n in (1, 2, 8)]
    assert got[0] and got[0] == got[1] == got[2]
    assert {d for d, _, _ in got[0]} == brute_contaminated(docs, items)


def test_decontamination_of_whole_documents(spark, awkward, nothing):
    items = [(i, prose(3000 + i, 30)) for i in range(20)] + [(20, None), (21, ""), (22, "tiny item"), (0, prose(3000, 30))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    long_ = prose(1, 3000).split()
    docs = [(1, " ".join([*long_[:1500], *items[3][1].split(), *long_[1500:]])), (2, items[4][1].upper().replace(" ", ", ")), (3, prose(7, 500)),
            (4, " ".join(items[5][1].split()[:12])), (5, None), (6, items[6][1] + " " + items[7][1]), (6, items[6][1])]
    df = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, item_id long")
    for size in (decontaminate.SHARD_WORDS, 100):
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.search(df, bench, shard_words=size).collect())
        assert got == [(1, 3), (2, 4), (6, 6), (6, 6), (6, 7)]
        kept = decontaminate.drop_contaminated(df, bench, shard_words=size)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert sorted(r.item_id for r in decontaminate.search(spark.createDataFrame([(9, items[0][1])], "doc_id long, text string"), bench).collect()) == [0, 0]
    assert decontaminate.search(nothing, bench).collect() == []
    assert decontaminate.search(df, bench.limit(0)).collect() == []
    assert decontaminate.drop_contaminated(awkward, bench.limit(0)).count() == awkward.count()
    assert decontaminate.search(awkward, bench).collect() == []


def test_short_items_match_in_a_row(spark):
    items = [(1, "Who wrote Emma? Austen"), (2, "yes"), (3, "Two two"), (4, "who wrote emma austen"), (5, "one two three four five"), (6, "..."), (7, prose(3000, 30))]
    docs = [(1, "He asked: who wrote Emma -- Austen?"), (2, "who wrote austen emma"), (3, "Yes."), (4, "two, two and one two three four five"),
            (5, "one two three four"), (6, "eyes"), (7, None), (8, ""), (9, items[6][1] + " yes"), (10, "two"), (11, "two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    for some in (items, items[:6]):
        bench = spark.createDataFrame(some, "item_id long, text string")
        want = [(1, 1), (1, 4), (3, 2), (4, 3), (4, 5), (9, 2)] + [(9, 7)] * (len(some) == 7)
        for size in (decontaminate.SHARD_WORDS, 4):
            rows = decontaminate.search(df, bench, shard_words=size).collect()
            assert sorted((r.doc_id, r.item_id) for r in rows) == want
            assert all((r.score, r.question_overlap, r.answer_overlap) == (1, 1, 1) for r in rows if r.item_id != 7)
            kept = decontaminate.drop_contaminated(df, bench, shard_words=size)
            assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8, 10, 11]


def test_decontamination_query_finds_all_whole_items(spark):
    from voxelframe.llm.queries import QUERIES

    items = [(r.item_id, " ".join(x.decode() for x in alnum(r.text))) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in rows_by_id(spark, FOLDER) for s in [" " + b" ".join(alnum(t)).decode() + " "] for i, x in items if f" {x} " in s}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_bm25_decontamination"](spark, FOLDER).collect()}
    assert want and want <= got and len(got - want) <= len(want) // 10


def brute_licences(text):
    w = [x.decode() for x in alnum(text)]
    places, labels = [], set()
    for p, label in licences.PHRASES.items():
        p = p.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licence_scan(spark, awkward, nothing):
    body = prose(5, 80)
    texts = ["", None, licences.TEMPLATES[4][1], body + " Licensed under CC BY-NC 4.0. " + body, "cc by cc by general public license", "all rights reserved " * 3,
             body, "Released\nunder the MIT License.", licences.TEMPLATES[1][1].replace("express or implied", "implied or express"), "permission is hereby granted"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(3)
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licences(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[2].labels == "mit" and got[2].score == 1 and got[3].labels == "cc-by,cc-by-nc" and got[7].labels == "mit"
    assert got[8].labels == "apache-2.0" and 0.9 < got[8].score < 1 and got[6].labels == "" and got[9].labels == "" and 0 < got[9].score < 0.2
    assert [(s.label, s.first, s.last) for s in got[3].spans if s.share == 1] == [("cc-by-nc", 80, 86)]
    assert {r.doc_id: r.n_words for r in licences.scan(awkward).collect() if r.doc_id} == {r.doc_id: len(alnum(r.text)) for r in awkward.collect() if r.doc_id}
    assert licences.scan(nothing).collect() == []
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licences(t) for d, t in rows_by_id(spark, FOLDER) for r in [_scan(spark)[d]])


_CACHE = {}


def _scan(spark):
    if not _CACHE:
        from voxelframe.llm.queries import QUERIES

        _CACHE.update({r.doc_id: r for r in QUERIES["op4_licence_automaton"](spark, FOLDER).collect()})
    return _CACHE


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=9), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=14))
def test_suffix_automaton_statistics(sequences, text):
    a = licences.SuffixAutomaton(sequences)
    for i, (length, state) in enumerate(a.statistics(text)):
        runs = [n for n in range(i + 2) if any(q[k : k + n] == text[i + 1 - n : i + 1] for q in sequences for k in range(len(q) - n + 1)) or n == 0]
        assert length == max(runs)
        if length:
            part = text[i + 1 - length : i + 1]
            assert a.ends[state] == {(j, k + length) for j, q in enumerate(sequences) for k in range(len(q) - length + 1) if q[k : k + length] == part}


def test_chains_follow_both_orders():
    assert licences.chains([(0, 0, 4), (6, 5, 4), (30, 9, 4)], 6)[0] == (0, 10, 8)
    assert licences.chains([(0, 5, 4), (5, 0, 4)], 6)[0] == (0, 4, 4)
    assert licences.chains([(0, 0, 4), (2, 2, 4)], 6)[0] == (0, 6, 6)


def test_ftrl_is_sparse_and_separates():
    r = random.Random(1)
    rows = []
    for i in range(600):
        y = int(i % 5 == 0)
        rows.append((np.array(sorted({*r.sample(range(1000, 4000), 30), *([7] if y else [])})), y))
    at, w, bias = toxicity.ftrl(rows, 12, 6, 1.0, 1.0, 3.0, 0.1)
    assert 7 in at and len(at) < 300 and w[at.tolist().index(7)] > 2 and bias < 0
    assert toxicity.ftrl([], 4, 2, 1.0, 1.0, 1.0, 1.0)[0].tolist() == []


def test_toxicity_learns_without_held_out_rows(spark, awkward, nothing):
    docs, labels = [], []
    for i in range(600):
        y = int(i % 6 == 0)
        docs.append((i, prose(i, 60) + (" you vile clod" if y else ""), "fr"))
        labels.append((i, y if toxicity_fold(i) != 2 else 1 - y, 0))  # held-out labels are wrong: they must not count
    labels += [(None, 1, 0), (3, None, 0), (5, 9, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    model = toxicity.fit(d.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int, text int"))
    rows = toxicity.score(d, model).collect()
    assert all(r.held_out == (toxicity_fold(r.doc_id) == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    right = [r.predicted == int(r.doc_id % 6 == 0) for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.97
    empty = {r.score for r in toxicity.score(awkward, model).collect() if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1 and toxicity.score(nothing, model).collect() == []
    none = toxicity.fit(nothing.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(awkward, none).collect()} == {0}


def plain_ftrl(rows, epochs, alpha, beta, l1, l2, prior):
    """One coordinate at a time, from the published update."""
    z, n, bias = {}, {}, "bias"
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= (l1 if i != bias else 0) else -(z[i] - math.copysign(l1 if i != bias else 0, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for s, y in rows:
            w = {i: weight(i) for i in [*s, bias]}
            g = 1 / (1 + math.exp(-sum(w.values()) - prior)) - y
            for i in w:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / alpha * w[i]
    return {i: weight(i) for i in z}


def test_ftrl_equals_plain_loop():
    r = random.Random(6)
    rows = [(np.array(sorted(r.sample(range(64), r.randint(0, 9))), np.int64), int(r.random() < 0.3)) for _ in range(200)]
    share = sum(y for _, y in rows) / len(rows)
    prior = math.log(share / (1 - share))
    for l1 in (0.0, 0.5, 3.0):
        at, w, bias = toxicity.ftrl(rows, 6, 3, 0.7, 1.0, l1, 0.1)
        want = plain_ftrl([(s.tolist(), y) for s, y in rows], 3, 0.7, 1.0, l1, 0.1, prior)
        live = {i: x for i, x in want.items() if x and i != "bias"}
        assert sorted(live) == at.tolist() and np.allclose([live[i] for i in at.tolist()], w) and math.isclose(bias, want["bias"] + prior)


def test_one_row_trains_of_a_repeated_id(spark, monkeypatch):
    trained = []
    docs = spark.range(30_000).selectExpr("id % 3 as doc_id", "concat('text ', id % 5, ' of words') as text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (0, 0)], "doc_id long, toxic int")
    real = toxicity.ftrl

    def counted(rows, *settings):
        at, w, _ = real(rows, *settings)
        return at, w, float(len(rows))

    monkeypatch.setattr(toxicity, "ftrl", counted)
    for limit in (2, 10):
        trained.append(toxicity.fit(docs, labels, max_train=limit)[2])
    open_ids = sum(toxicity_fold(i) != 2 for i in range(3))
    assert trained == [min(2, open_ids), open_ids]


def test_toxicity_features_stay_parallel(spark):
    docs = spark.range(0, 70, 1, 7).selectExpr("id as doc_id", "concat('some text ', id) as text")
    labels = spark.range(0, 70, 1, 1).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    context = spark.sparkContext
    context.setJobGroup("features", "features")
    try:
        toxicity.fit(docs, labels)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = [status.getStageInfo(i) for job in status.getJobIdsForGroup("features") for i in status.getJobInfo(job).stageIds]
    assert 7 in [x.numTasks for x in stages if x]


def toxicity_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=8), max_size=9))
def test_loser_tree(lists):
    lists = [sorted((x, i) for x in q) for i, q in enumerate(lists)]
    assert list(warc.loser_tree_merge(lists)) == sorted(x for q in lists for x in q)


def brute_captures(rows):
    low = {}
    for i, _, html in rows:
        d = hashlib.sha1((html or "").encode()).digest()
        if i is not None:
            low[d] = min(i, low.get(d, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        d = hashlib.sha1(data).digest()
        first = low.get(d)
        again = first is not None and i != first
        out.append((str(i), len(data), base64.b32encode(d).decode(), "revisit" if again else "response", str(first if again else None)))
    return sorted(out)


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 7)
    monkeypatch.setattr(warc, "RANGE_BYTES", 2000)
    rows = [(i, f"http://www.a{i % 5}.Example.org/p{i % 3}?b=2&a={i}", f"<p>{i % 11}</p>\r\n\r\nWARC/1.1\r\n\r\né") for i in range(60)]
    rows += [(70, None, None), (71, "", ""), (None, "http://x.org", "<p>1</p>"), (None, None, "alone"), (72, "not a url\r\nX: y", "alone too"), (5, "http://a0.example.org/", rows[5][2]), (73, "http://[bad", "é" * 5000)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, archive string, at int").repartition(4)
    got = warc.write_and_read(df).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute_captures(rows)
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.range_no, r.range_pos))]
    assert order == sorted(order) and len({r.range_no for r in got}) > 1 and len({r.archive for r in got}) > 4
    assert warc.write_and_read(df.limit(0)).collect() == []


def test_captures_of_any_page_id(spark):
    ids = [0, 1, 10**11, 3 * 10**11, 10**15, 2**63 - 1, -(2**63), -5, None]
    rows = [(i, f"http://x.org/{k % 2}", f"page {k % 4}") for k, i in enumerate(ids)]
    got = warc.write_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute_captures(rows)
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.range_no, r.range_pos))]
    assert order == sorted(order) and all(re.fullmatch(r"202[45]-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.captured) for r in got)


def test_one_payload_in_most_pages(spark):
    rows = [(i, f"http://x.org/{i}", "the same page" if i % 3 else f"page {i}") for i in range(400)] + [(None, None, "the same page")]
    got = warc.write_and_read(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute_captures(rows)


def test_capture_times(spark, tmp_path):
    rows = [(1, "http://x.org", "a", 0), (2, "http://x.org", "b", 253_402_300_799), (3, "http://x.org", "c", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, seen long")
    assert [r.page_id for r in sorted(warc.write_and_read(df, captured="seen").collect(), key=lambda r: r.range_pos)] == [1, 3, 2]
    with pytest.raises(Exception, match="1970 and 9999"):
        warc.write(df.withColumn("seen", F.lit(253_402_300_800)), str(tmp_path / "late"), captured="seen")


def test_url_keys():
    assert warc.url_key("https://WWW.Example.com:443/a/B?y=2&x=1#f") == warc.url_key("http://example.com/a/B?x=1&y=2") == "com,example)/a/B?x=1&y=2"


def test_archive_query(spark):
    from voxelframe.llm.queries import QUERIES

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    got = QUERIES["op3_warc_index_merge"](spark, FOLDER).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute_captures(rows)
