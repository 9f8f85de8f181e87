"""Byte-level kernels shared by the operators: words, lines and their hashes over whole Arrow batches.

A batch of texts is one byte buffer with offsets, as Arrow holds it. Words and lines are ranges of that buffer, and
all work is done on arrays over the whole buffer. Long batches are cut into runs of documents of bounded size, so
memory follows the longest document, not the batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_BYTES = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """A run of documents as one buffer: ``buf`` (uint8) and ``offs`` (one more than documents)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int = 0):
        self.buf, self.offs, self.first = buf, offs, first

    def __len__(self) -> int:
        return len(self.offs) - 1

    def lower(self) -> Texts:
        return Texts(LOWER[self.buf], self.offs, self.first)

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sums of per-byte flags by document."""
        c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def ranges(self, separator: np.ndarray) -> Ranges:
        """Maximal ranges without separator bytes (``separator``: 256 flags) inside each document."""
        n = len(self.buf)
        if not n:
            return Ranges(self, np.zeros(0, np.int64), np.zeros(0, np.int64))
        sep = separator[self.buf]
        open_, close = np.empty(n, bool), np.empty(n, bool)
        open_[0] = close[-1] = True
        open_[1:], close[:-1] = sep[:-1], sep[1:]
        inner = self.offs[1:-1]
        open_[inner[inner < n]] = True
        close[inner[inner > 0] - 1] = True
        body = ~sep
        return Ranges(self, np.flatnonzero(body & open_), np.flatnonzero(body & close) + 1, body=body)

    def words(self) -> Ranges:
        return self.ranges(BLANK)

    def lines(self) -> Ranges:
        """All lines, split at line feeds, empty ones included; a document has one more line than line feeds."""
        cut = np.flatnonzero(NEWLINE[self.buf])
        starts = np.sort(np.concatenate((self.offs[:-1], cut + 1)), kind="stable")
        ends = np.sort(np.concatenate((cut, self.offs[1:])), kind="stable")
        of = np.repeat(np.arange(len(self)), 1 + self.per_document(NEWLINE[self.buf]))
        return Ranges(self, starts, ends, of)


class Ranges:
    """Words or lines of a run of documents: byte ranges with the document of each."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, of: np.ndarray | None = None, body: np.ndarray | None = None):
        """``body``: flags of the bytes inside the ranges, if they are at hand."""
        self.texts, self.starts, self.ends, self.body = texts, starts, ends, body
        self.of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, texts.offs))) if of is None else of

    def __len__(self) -> int:
        return len(self.starts)

    def per_document(self) -> np.ndarray:
        return np.bincount(self.of, minlength=len(self.texts))

    def bounds(self) -> np.ndarray:
        """Positions where documents begin in this list, and its length."""
        return np.concatenate(([0], np.cumsum(self.per_document())))

    def packed(self) -> pa.Array:
        """The ranges as an Arrow binary array."""
        n = self.ends - self.starts
        offs = np.concatenate(([0], np.cumsum(n)))
        data = self.texts.buf[spread(self.starts, n) if self.body is None else self.body]
        return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])

    def interned(self) -> tuple[np.ndarray, pa.Array]:
        """The distinct byte strings and, for each range, the place of its own; exact."""
        d = self.packed().dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


class Hasher:
    """64-bit hashes of byte ranges: a polynomial over the bytes, then mixed with the length. One per task."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 0):
        self.base = np.uint64((self.BASE ^ (seed * 0xD1342543DE82EF94)) % 2**64 | 5)
        inverse = pow(int(self.base), -1, 2**64)
        self.inverse = np.uint64(inverse)
        self.up = self.down = np.zeros(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.up):
            return self.up, self.down
        up = np.full(n + 1, self.base, np.uint64)
        down = np.full(n + 1, self.inverse, np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n <= 2 * RUN_BYTES:
            self.up, self.down = up, down
        return up, down

    def ranges(self, r: Ranges) -> np.ndarray:
        buf = r.texts.buf
        n = len(buf)
        up, down = self.powers(max(n, 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[r.ends] - sums[r.starts]) * down[r.starts]
        return mix(h + (r.ends - r.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive items inside one document, and the place of the first item of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= np.uint64(0x9FB21C651E98DF25)
        g += h[j : j + n]
    at = np.flatnonzero(of[:n] == of[k - 1 :])
    return mix(g[at]), at


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Flags over ``n`` items: inside some range of ``k`` items that begins at ``at``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + k, n), -1)
    return np.cumsum(d[:-1]) > 0


def window_minima(h: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` items that begins at a place in ``first``: the place of its smallest hash, the last of equals."""
    best, at = h[first], first.copy()
    for j in range(1, w):
        x = h[first + j]
        take = x <= best
        best[take], at[take] = x[take], first[take] + j
    return at


def texts_of(column: pa.Array | pa.ChunkedArray, run_bytes: int = RUN_BYTES) -> Iterator[Texts]:
    """The texts of a column in runs of about ``run_bytes``; one longer document is a run of its own."""
    for a in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(a):
            continue
        a = pc.fill_null(a.cast(pa.large_string()), "")
        _, offsets, data = a.buffers()
        offs = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + run_bytes, "right")) - 1)
            hi = min(hi, len(a))
            yield Texts(buf[offs[lo] : offs[hi]], (offs[lo : hi + 1] - offs[lo]).copy(), lo)
            lo = hi


def map_runs(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch, Texts], dict | list | None], schema: str, make: Callable | None = None, end: Callable | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Arrow map over runs of documents.

    ``fn(state, rows, texts)`` gets the rows of the run and their texts and returns columns (a dict) or nothing;
    ``make()`` builds the state of a task, ``end(state)`` may return last columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def build(cols: dict) -> pa.RecordBatch:
        arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in target)]
        return pa.RecordBatch.from_arrays(arrays, schema=target)

    def run(batches):
        state = make() if make else None
        for b in batches:
            for t in texts_of(b.column(b.schema.get_field_index(text)), run_bytes):
                got = fn(state, b.slice(t.first, len(t)), t)
                if got is not None:
                    yield build(got)
        if end:
            got = end(state)
            if got is not None:
                yield build(got)

    return df.mapInArrow(run, schema)


def to_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sized(df: DataFrame, per_piece: int) -> int:
    """How many pieces of about ``per_piece`` stored bytes the table makes, by the planner's own size of it.

    A table of unknown size (the planner then assumes exabytes) gets the session's number of shuffle partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // per_piece))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just these columns under these names: whatever else the table holds can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of ranges, one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


class IdCache:
    """Token ids of distinct byte strings, kept for a task; ``encode`` gets the new ones and returns (ids, lengths).

    The strings stay in Arrow buffers and are looked up there, so an entry costs its bytes and no Python objects. A cache with
    more than ``most`` strings keeps those of the last call.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.large_binary())
        self.ids, self.starts, self.lens, self.last = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        starts, lens = self.starts[self.last], self.lens[self.last]
        self.keys, self.ids, self.lens = self.keys.take(pa.array(self.last)), self.ids[spread(starts, lens)], lens
        self.starts = np.cumsum(lens) - lens

    def get(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of each of these distinct strings, as places in ``self.ids``."""
        if len(self.keys) > self.most:
            self.trim()
        at = pc.index_in(strings, value_set=self.keys)
        is_new = pc.is_null(at)
        new = strings.filter(is_new)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            at[is_new.to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(len(new))
            ids, lens = self.encode(new.to_pylist())
            starts = len(self.ids) + np.cumsum(lens) - lens
            self.keys = pa.concat_arrays([self.keys, new])
            self.ids, self.starts, self.lens = np.concatenate((self.ids, ids)), np.concatenate((self.starts, starts)), np.concatenate((self.lens, lens))
        self.last = at
        return self.starts[at], self.lens[at]

    def of(self, r: Ranges) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the ranges in order, and the number of ids of each document."""
        place, distinct = r.interned()
        starts, lens = self.get(distinct)
        n = lens[place]
        return self.ids[spread(starts[place], n)], np.bincount(r.of, n, len(r.texts)).astype(np.int64)


def id_lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """An Arrow list per document."""
    offs = np.concatenate(([0], np.cumsum(n)))
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
