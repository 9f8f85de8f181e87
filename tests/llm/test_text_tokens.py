"""Word kernels, byte-level BPE and packed ids against the libraries and exact round trips."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelframe.llm import bpe, packed_ids
from voxelframe.llm import text as T

ODD = ["", None, "  a  b   c\n\n\n d  ", "　x   y ", "aaaaaaa aaaa aaaaaaaaaaaa", "don't I'll 123 !!! \x1c\x1d x", "\r\n\r\n x", "é é", "<|endoftext|> a", "the" * 500, "a\x85 b", "İstanbul"]
RANKS = bpe.load_ranks(bpe.default_path())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def runs(texts, size=1 << 20):
    return list(T.texts_of(pa.array(texts, pa.string()), size))


def test_words_lines_and_long_documents():
    for size in (1, 7, 1 << 20):
        words, lines, n = [], [], 0
        for t in runs(ODD, size):
            r = t.words()
            words += [t.buf[a:b].tobytes() for a, b in zip(r.starts, r.ends)]
            x = t.lines()
            lines += [(n + int(d), t.buf[a:b].tobytes()) for d, a, b in zip(x.of, x.starts, x.ends)]
            n += len(t)
        assert n == len(ODD)
        assert words == [w for x in ODD for w in re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode())]
        assert lines == [(i, p) for i, x in enumerate(ODD) for p in (x or "").encode().split(b"\n")]


def test_interned_and_hashed_words_agree():
    t = runs(["b a b", "", "a c"])[0]
    place, distinct = t.words().interned()
    assert [distinct[int(i)].as_py() for i in place] == [b"b", b"a", b"b", b"a", b"c"]
    h = T.Hasher().ranges(t.words())
    assert len(set(h.tolist())) == 3 and h[0] == h[2] and h[1] == h[3]


def encoded(texts, size=1 << 20):
    encoder, out = bpe.Encoder(RANKS, public_tokenizers.PATTERN), []
    for t in runs(texts, size):
        ids, n = encoder(t)
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


def test_merge_replay_equals_library():
    assert encoded(ODD) == [LIBRARY.encode_ordinary(x or "") for x in ODD]
    assert encoded(ODD, 5) == encoded(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abeht'\n\t é  1!日", max_size=60), min_size=1, max_size=5))
def test_merge_replay_equals_library_on_any_text(texts):
    assert encoded(texts) == [LIBRARY.encode_ordinary(x) for x in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12))
def test_replay_with_ranks_out_of_order(word):
    """A merge may make a pair of a lower rank: then the lower one comes first, one place at a time."""
    ranks = {bytes([c]): i for i, c in enumerate(b"abcd")}
    ranks |= {b"bc": 9, b"abc": 5, b"cd": 8, b"bcd": 6, b"aa": 7, b"ab": 20}
    ids = list(word)
    replay = bpe.MergeReplay(ranks)
    got = replay.run([bytes(b"abcd"[i] for i in word)])[0].tolist()
    names = {v: k for k, v in ranks.items()}
    parts = [names[i] for i in ids]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert got == [ranks[p] for p in parts]


def test_encode_and_decode_rows(awkward, nothing):
    rows = bpe.decode(bpe.encode(awkward)).collect()
    texts = awkward.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), LIBRARY.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in texts)
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in rows) == want
    assert bpe.decode(bpe.encode(nothing)).collect() == []


def test_decode_unknown_ids(spark):
    df = spark.createDataFrame([(1, [64, None, 999_999, -5, 65]), (2, None), (3, [])], "doc_id long, ids array<int>")
    names = {v: k for k, v in RANKS.items()}
    assert [bytes(r.decoded) for r in bpe.decode(df).orderBy("doc_id").collect()] == [names[64] + names[65], b"", b""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([1, 50, 97, 100]))
def test_packed_blocks_round_trip(values, percentile):
    v = np.array(values, np.int64)
    s = packed_ids.Segment(packed_ids.pack(v, percentile=percentile))
    assert s.blocks().tolist() == values
    for b in range(len(s.low)):
        assert s.blocks(b, b + 1).tolist() == values[b * 128 : (b + 1) * 128]


def test_packed_blocks_patch_outliers():
    v = np.arange(1000) % 50 + 7000
    plain = len(packed_ids.pack(v))
    v[::100] = 4_000_000_000
    assert len(packed_ids.pack(v)) < plain + 10 * 12


def test_token_files(spark, awkward, nothing):
    library = Tokenizer.from_file(packed_ids.default_path())
    rows = packed_ids.write_and_read(awkward).withColumn("crc", F.crc32("ids")).collect()
    start = 0
    assert len(rows) == awkward.count()
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.crc
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = sorted((str(r.doc_id), [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in awkward.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert packed_ids.write_and_read(nothing).collect() == []


@pytest.mark.parametrize("text", ODD)
def test_words_of_the_library(text):
    cache = packed_ids._tokenizer(open(packed_ids.default_path(), encoding="utf-8").read())
    library = Tokenizer.from_file(packed_ids.default_path())
    for t in runs([text or ""]):
        ids, _ = cache.of(t.words())
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_digest_of_decoded_text(spark, awkward):
    got = bpe.decode(bpe.encode(awkward)).select("doc_id", F.sha2("decoded", 256).alias("h")).collect()
    want = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in awkward.collect()}
    assert {(r.doc_id, r.h) for r in got} == want
