"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

Texts are cut by the pattern into pieces. The distinct pieces of a run of documents form a small corpus: all their
symbols lie in one array, linked to their neighbours, with an inverted index from the rank of a pair of neighbours to
the places where it stands. Merges are replayed in rank order; each touches the places of its own pair and re-ranks only
the new pairs to their left and right. The ids of pieces seen before come from a cache of the task.

The result is that of merging each piece alone, lowest rank first and leftmost among equals; a piece that is itself a token
is that token. Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike;
ids outside the vocabulary, or null, decode to nothing.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from voxelframe.llm.text import IdCache, Ranges, Texts, id_lists, map_runs, only, spread

RUN_BYTES = 3 << 20
CACHED = 180_000
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Replays all merges of a vocabulary over a list of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        p = np.array(pairs, np.int64).reshape(-1, 3)
        keys = p[:, 0] << 32 | p[:, 1]
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], p[order, 2]
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # a merge whose result can at once be part of an earlier merge must be replayed one place per piece at a time
        self.safe = np.ones(max(ranks.values(), default=0) + 1, bool)
        self.safe[p[p[:, 2] <= p[:, 0], 0]] = False
        self.safe[p[p[:, 2] <= p[:, 1], 1]] = False

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 where they don't merge."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def run(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each piece."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        if (symbol < 0).any():
            raise ValueError("a byte has no rank")
        n = len(symbol)
        piece = np.repeat(np.arange(len(pieces)), lens)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lens)
        after[ends[lens > 0] - 1] = n
        before[(ends - lens)[lens > 0]] = -1
        pair = np.full(n, -1)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            """Rank the pairs that begin at these places and enter them in the index."""
            r = self.rank(symbol[at], symbol[after[at]])
            pair[at] = r
            good = r >= 0
            at, r = at[good], r[good]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for x, part in zip(r[np.concatenate(([0], cut))].tolist(), np.split(at, cut) if len(cut) else [at]):
                if x in index:
                    index[x].append(part)
                else:
                    index[x] = [part]
                    heapq.heappush(queue, x)

        note(np.flatnonzero(after < n))
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            at = np.sort(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[pair[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                if self.safe[r]:
                    touch = np.concatenate(([False], after[at[:-1]] == at[1:]))
                    if touch.any():  # of a run of overlapping places take every other one, from the left
                        begin = np.maximum.accumulate(np.where(touch, 0, np.arange(len(at))))
                        at = at[(np.arange(len(at)) - begin) % 2 == 0]
                else:
                    first = np.concatenate(([True], piece[at[1:]] != piece[at[:-1]]))
                    if not first.all():
                        index[r] = [at[~first]]
                        heapq.heappush(queue, r)
                    at = at[first]
            gone = after[at]
            symbol[at] = r
            symbol[gone] = pair[gone] = -1
            follow = after[gone]
            after[at] = follow
            inside = follow < n
            before[follow[inside]] = at[inside]
            pair[at] = -1
            left = before[at]
            note(np.unique(np.concatenate((left[left >= 0], at[inside]))))
        keep = symbol >= 0
        return symbol[keep].astype(np.int32), np.bincount(piece[keep], minlength=len(pieces))


class Encoder:
    """Ids of whole texts; one per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        # the blank characters of the pattern are those of Unicode's White_Space
        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(pattern).findall
        self.ranks, self.replay = ranks, MergeReplay(ranks)
        self.chunks, self.pieces = IdCache(self.encode_chunks, CACHED), IdCache(self.encode_pieces, CACHED)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        ids, n = self.replay.run([p for p, w in zip(pieces, whole.tolist()) if w < 0])
        lens = np.ones(len(pieces), np.int64)
        lens[whole < 0] = n
        out = np.empty(int(lens.sum()), np.int32)
        known = np.repeat(whole >= 0, lens)
        out[known], out[~known] = whole[whole >= 0], ids
        return out, lens

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [[p.encode() for p in self.find(c.decode())] for c in chunks]
        flat = [p for ps in found for p in ps]
        d = pa.array(flat, pa.large_binary()).dictionary_encode()
        at = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts, lens = self.pieces.get(d.dictionary)
        of = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, found), np.int64, len(found)))
        return self.pieces.ids[spread(starts[at], lens[at])], np.bincount(of, lens[at], len(chunks)).astype(np.int64)

    def __call__(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks.of(chunks(t))


def chunks(t: Texts) -> Ranges:
    """Parts of texts whose pieces don't depend on what stands around them: blanks and the word after them.

    No piece goes on over a blank that follows a word, so a text may be cut there. A text with blank characters beyond
    ASCII is one chunk, as those stand inside words here.
    """
    words = t.words()
    odd = odd_blanks(t)
    if odd.any():
        keep = ~odd[words.of]
        words = Ranges(t, words.starts[keep], words.ends[keep], words.of[keep])
    n = words.per_document()
    last = np.cumsum(n) - 1
    lo, hi = t.offs[:-1], t.offs[1:]
    tail = np.where(n > 0, words.ends[np.maximum(last, 0)] if len(words) else lo, lo)
    rest = np.flatnonzero(tail < hi)
    begin = np.concatenate(([0], words.ends[:-1])) if len(words) else np.zeros(0, np.int64)
    first = (np.cumsum(n) - n)[n > 0]
    begin[first] = lo[n > 0]
    starts = np.concatenate((begin, tail[rest]))
    order = np.argsort(starts, kind="stable")
    of = np.concatenate((words.of, rest))
    return Ranges(t, starts[order], np.concatenate((words.ends, hi[rest]))[order], of[order], np.ones(len(t.buf), bool))


def odd_blanks(t: Texts) -> np.ndarray:
    """Documents with White_Space characters beyond ASCII."""
    b = t.buf
    if len(b) < 2 or int(b.max()) < 0xC2:
        return np.zeros(len(t), bool)
    c2 = np.flatnonzero((b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0)))
    lead = np.flatnonzero((b[:-2] >= 0xE1) & (b[:-2] <= 0xE3))
    if len(lead):
        code = (b[lead].astype(np.int64) << 16) | (b[lead + 1].astype(np.int64) << 8) | b[lead + 2]
        bad = (code == 0xE19A80) | ((code >= 0xE28080) & (code <= 0xE2808A)) | np.isin(code, [0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
        c2 = np.concatenate((c2, lead[bad]))
    return np.bincount(np.searchsorted(t.offs, c2, "right") - 1, minlength=len(t)) > 0


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every row. The vocabulary travels to the tasks by value."""
    ranks, pattern = load_ranks(ranks_path or default_path()), pattern or default_pattern()

    def run(encoder, rows, t):
        ids, n = encoder(t)
        return {"doc_id": rows.column(0), "n_tokens": n, "ids": id_lists(ids, n)}

    slim = only(docs, doc_id=doc_id, text=text)
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_runs(slim, "text", run, f"doc_id {kind}, n_tokens long, ids array<int>", lambda: Encoder(ranks, pattern), run_bytes=RUN_BYTES)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """The table with the bytes of its ids in a further column."""
    ranks = load_ranks(ranks_path or default_path())
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        tokens[r] = token

    def run(batches):
        flat = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(lens) - lens
        for b in batches:
            for lo in range(0, b.num_rows, 300):
                part = b.slice(lo, 300)
                lists = part.column(part.schema.get_field_index(ids))
                x = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                known = (x >= 0) & (x < len(tokens))
                x = np.where(known, x, 0)
                size = np.where(known, lens[x], 0)
                sums = np.concatenate(([0], np.cumsum(size)))
                offs = sums[np.concatenate(([0], np.cumsum(n)))]
                data = flat[spread(starts[x], size)]
                text = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.binary())], [*part.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{out}` binary"
    return encoded.mapInArrow(run, schema)
