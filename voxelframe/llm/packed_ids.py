"""Token ids in files of patched frame-of-reference blocks.

Documents are sorted by id into key ranges, encoded, and their ids, an end id after each document, are packed into segments
of about ``SEGMENT`` ids. A segment holds blocks of ``BLOCK`` ids: the block's minimum is subtracted, the rest is cut to the
width that ``PERCENTILE`` percent of the block's values fit in, and the values beyond it go to an exception list. A table of
block starts gives access to any block without the ones before it.

A folder of segments is written by Spark (one Parquet row per segment, the packed bytes as they are), so any store Spark can
reach will do, and only finished tasks leave files. Reading back needs the segments and the totals of the key ranges.

Defined results: a null or empty text is the end id alone; documents with the same id, or a null id (first), follow in the order
of the text's hash; no documents give no segments.
"""

from __future__ import annotations

import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm.text import IdCache, map_runs, only, sized, spread
from voxelframe.session import scratch_path

BLOCK = 128
PERCENTILE = 97
SEGMENT = 1 << 20
END_ID = 1
RANGE_BYTES = 32 << 20
DEFAULT_TOKENIZER = "word_bpe_49k.json"
RUN_BYTES = 4 << 20
CACHED = 1_200_000
HEAD = "<4sIII"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def bits_of(v: np.ndarray) -> np.ndarray:
    """Bits that each value (below 2**32) needs."""
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """A segment: header, minima, widths, exception counts, block starts, packed words, exceptions."""
    n = len(values)
    nb = -(-n // block)
    v = np.zeros(nb * block, np.uint64)
    v[:n] = values
    if n:
        v[n:] = v[n - 1]
    v = v.reshape(nb, block)
    low = v.min(axis=1) if nb else np.zeros(0, np.uint64)
    d = v - low[:, None]
    bits = bits_of(d)
    width = np.sort(bits, axis=1)[:, -(-block * percentile // 100) - 1] if nb else np.zeros(0, np.int64)
    patched = bits > width[:, None]
    row, at = np.nonzero(patched)
    words = -(-block * width // 64)
    starts = np.concatenate(([0], np.cumsum(words)))
    out = np.zeros(int(starts[-1]), np.uint64)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        part = d[rows] & np.uint64((1 << w) - 1)
        m = np.zeros((len(rows), -(-block * w // 64)), np.uint64)
        for j in range(block):
            word, shift = divmod(j * w, 64)
            m[:, word] |= part[:, j] << np.uint64(shift)
            if shift + w > 64:
                m[:, word + 1] |= part[:, j] >> np.uint64(64 - shift)
        out[(starts[rows][:, None] + np.arange(m.shape[1])).ravel()] = m.ravel()
    counts = patched.sum(axis=1)
    return b"".join((
        struct.pack(HEAD, b"PFOR", n, block, len(row)), low.astype("<u4").tobytes(), width.astype("u1").tobytes(), counts.astype("<u2").tobytes(),
        starts.astype("<u4").tobytes(), out.astype("<u8").tobytes(), at.astype("<u2").tobytes(), d[row, at].astype("<u4").tobytes(),
    ))


class Segment:
    """A packed segment; ``blocks`` unpacks a range of blocks."""

    def __init__(self, data: bytes):
        magic, self.n, self.block, n_out = struct.unpack_from(HEAD, data)
        if magic != b"PFOR":
            raise ValueError("not a segment")
        nb = -(-self.n // self.block)
        at = struct.calcsize(HEAD)

        def take(dtype, count):
            nonlocal at
            a = np.frombuffer(data, dtype, count, at)
            at += a.nbytes
            return a

        self.low, self.width, counts, self.starts = take("<u4", nb), take("u1", nb), take("<u2", nb), take("<u4", nb + 1)
        self.words, self.place, self.value = take("<u8", int(self.starts[-1]) if nb else 0), take("<u2", n_out), take("<u4", n_out)
        self.patches = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))

    def blocks(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids of the blocks ``lo`` to ``hi``."""
        nb = len(self.low)
        hi = nb if hi is None else hi
        b = self.block
        d = np.zeros((hi - lo, b), np.uint64)
        width = self.width[lo:hi]
        for w in np.unique(width).tolist():
            if not w:
                continue
            rows = np.flatnonzero(width == w)
            m = self.words[self.starts[lo:hi][rows].astype(np.int64)[:, None] + np.arange(-(-b * w // 64))]
            part, mask = np.empty((len(rows), b), np.uint64), np.uint64((1 << w) - 1)
            for j in range(b):
                word, shift = divmod(j * w, 64)
                x = m[:, word] >> np.uint64(shift)
                if shift + w > 64:
                    x = x | (m[:, word + 1] << np.uint64(64 - shift))
                part[:, j] = x & mask
            d[rows] = part
        p0, p1 = self.patches[lo], self.patches[hi]
        row = np.repeat(np.arange(hi - lo), np.diff(self.patches[lo : hi + 1]))
        d[row, self.place[p0:p1]] = self.value[p0:p1]
        return (d + self.low[lo:hi, None]).astype(np.uint32).ravel()[: self.n - lo * b]


# words of plain letters with ASCII marks behind them: one or two parts to the tokenizer, whatever its Unicode tables
PLAIN = "([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\\[-`{-~]*)"

# The text handling of a tokenizer under which plain words have these parts
LOWER_WORDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _tokenizer(definition: str) -> IdCache:
    """Ids of words by the tokenizers library.

    If the tokenizer lowers its text and splits it as :data:`WORD_PARTS` says, the distinct parts of plain words are encoded
    many at a time, joined by blanks, by the same model without that text handling, and told apart by the tokens that end
    a part. All other words, those that hold the string of an added token too, are encoded as they are, as are all words of other
    tokenizers.
    """
    import json
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_str(definition)
    d = json.loads(definition)
    split = ((d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
    suffix = d["model"].get("end_of_word_suffix")
    simple = bool(suffix) and split == WORD_PARTS and (d.get("normalizer") or {}).get("normalizers") == LOWER_WORDS
    vocabulary = t.get_vocab()
    closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    closes[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
    plain = re.compile(PLAIN).fullmatch
    lean = Tokenizer.from_str(definition)
    if simple:
        lean.normalizer = None
        lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def singly(words: list[str]):
        got = [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(lens.sum())), lens

    def joined(words: list[str], found: list):
        parts: dict[str, int] = {}
        first = np.fromiter((parts.setdefault(m[1].lower(), len(parts)) for m in found), np.int64, len(found))
        second = np.fromiter((parts.setdefault(m[2], len(parts)) if m[2] else -1 for m in found), np.int64, len(found))
        names = list(parts)
        got = lean.encode_batch_fast([" ".join(names[lo : lo + 512]) for lo in range(0, len(names), 512)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.int32)
        ends = np.flatnonzero(closes[ids]) + 1
        if len(ends) != len(names):
            return singly(words)
        lens = np.diff(ends, prepend=0)
        starts = ends - lens
        both = np.stack((first, second), axis=1).ravel()
        both_lens = np.where(both >= 0, lens[both], 0)
        return ids[spread(starts[both], both_lens)], both_lens.reshape(-1, 2).sum(axis=1)

    def encode(strings: list[bytes]):
        lens, flat = np.zeros(len(strings), np.int64), [np.zeros(0, np.int32)]
        for lo in range(0, len(strings), 1 << 15):  # an encoding holds far more than its ids
            words = [w.decode() for w in strings[lo : lo + (1 << 15)]]
            found = list(map(plain, words)) if simple else [None] * len(words)
            easy = np.fromiter((m is not None for m in found), bool, len(found))
            n = np.zeros(len(words), np.int64)
            ids_e = ids_h = flat[0]
            if easy.any():
                ids_e, n[easy] = joined([w for w, m in zip(words, found) if m], [m for m in found if m])
            if not easy.all():
                ids_h, n[~easy] = singly([w for w, m in zip(words, found) if not m])
            out = np.empty(int(n.sum()), np.int32)
            is_easy = np.repeat(easy, n)
            out[is_easy], out[~is_easy] = ids_e, ids_h
            flat.append(out)
            lens[lo : lo + len(words)] = n
        return np.concatenate(flat), lens

    return IdCache(encode, CACHED)


SEGMENTS = "part int, first long, n_docs long, n_ids long, docs binary, packed binary"


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the segments of all documents to a new folder."""
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        definition = f.read()
    slim = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", F.xxhash64("text"))
    ranges = slim.repartitionByRange(sized(docs, RANGE_BYTES), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    class State:
        def __init__(self):
            from pyspark import TaskContext

            self.cache, self.part, self.first = _tokenizer(definition), TaskContext.get().partitionId(), 0
            self.ids, self.docs, self.lens = [], [], []
            self.held = 0

        def close(self):
            self.cache.clear()  # the last segment needs the room
            return self.flush()

        def flush(self):
            if not self.docs:
                return None
            ids, lens = np.concatenate(self.ids), np.concatenate(self.lens)
            table = pa.table({"doc_id": pa.concat_arrays(self.docs), "n": lens})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            row = {"part": [self.part], "first": [self.first], "n_docs": [len(lens)], "n_ids": [len(ids)], "docs": [sink.getvalue().to_pybytes()], "packed": [pack(ids)]}
            self.first += len(ids)
            self.ids, self.docs, self.lens, self.held = [], [], [], 0
            return row

    def run(state, rows, t):
        ids, n = state.cache.of(t.words())
        out = np.full(len(ids) + len(t), end_id, np.int64)
        ends = np.cumsum(n + 1)
        mine = np.ones(len(out), bool)
        mine[ends - 1] = False
        out[mine] = ids
        state.ids.append(out)
        state.lens.append(n + 1)
        state.docs.append(rows.column(0))
        state.held += len(out)
        return state.flush() if state.held >= SEGMENT else None

    map_runs(ranges, "text", run, SEGMENTS, State, State.close, RUN_BYTES).write.mode("error").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, 32-bit little endian) of each document of a folder."""
    segments = spark.read.parquet(path)
    # one small row per key range, of which the writer made a known number
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, at = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        base[r.part], at = at, at + r.n
    if not base:
        base[0] = 0

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                part, first, docs, packed = (b.column(b.schema.get_field_index(c))[i] for c in ("part", "first", "docs", "packed"))
                part, first = part.as_py(), first.as_py()
                ids = Segment(packed.as_buffer()).blocks()
                table = pa.ipc.open_stream(docs.as_buffer()).read_all().combine_chunks()
                n = table.column("n").to_numpy()
                ends = np.cumsum(n)
                offs = np.concatenate(([0], ends)) * 4
                lists = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(ids)])
                key = table.column("doc_id").combine_chunks() if isinstance(table.column("doc_id"), pa.ChunkedArray) else table.column("doc_id")
                yield pa.RecordBatch.from_pydict({"doc_id": key, "start": base[part] + first + ends - n, "n_tokens": n, "ids": lists.cast(pa.binary())})

    return segments.select("part", "first", "docs", "packed").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, **names) -> DataFrame:
    """Write to a new folder below the shared one and read it back."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write(docs, path, **names)
    return read(docs.sparkSession, path)
