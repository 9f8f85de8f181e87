"""Which members share a key, at any skew: keys travel as packed arrays in shards.

Tasks gather (key, member) pairs, and of a key with several members among them send only the smallest on to the key's shard;
the others are known to share it and travel to any shard. A shard then holds at most one row per task and key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PACKED = "kind int, shard int, a binary, b binary, c binary"
SENT, KNOWN, EXTRA = 0, 1, 2  # pairs of a key's shard, pairs known to share, columns of the caller
FLUSH_PAIRS = 1_500_000


def concat(parts: list[dict]) -> dict | None:
    """One set of columns from several."""
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return {k: pa.concat_arrays([p[k] for p in parts]) if isinstance(v, pa.Array) else np.concatenate([p[k] for p in parts]) for k, v in parts[0].items()}


def blobs(kind: int, shard: np.ndarray, *columns: np.ndarray) -> dict:
    """One row per shard with its part of up to three columns of 8-byte items."""
    order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 65536 else shard, kind="stable")
    shard = shard[order]
    begin = np.flatnonzero(np.diff(shard, prepend=-1))
    rows: dict = {"kind": np.full(len(begin), kind), "shard": shard[begin]}
    for i, name in enumerate(("a", "b", "c")):
        if i < len(columns):
            data = np.ascontiguousarray(columns[i][order])
            offs = np.append(begin, len(data)) * 8
            rows[name] = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
        else:
            rows[name] = pa.nulls(len(begin), pa.large_binary())
    return rows


def distinct_pairs(key: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((member, key))
    key, member = key[order], member[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
    return key[new], member[new]


class Packer:
    """Gathers the pairs of a task. Keys and members are unsigned 64-bit."""

    def __init__(self, shards: int, local_group: int = 2):
        self.shards, self.local_group, self.held, self.turn = shards, local_group, 0, 0
        self.keys: list[np.ndarray] = []
        self.members: list[np.ndarray] = []

    def add(self, key: np.ndarray, member: np.ndarray) -> dict | None:
        self.keys.append(key)
        self.members.append(member)
        self.held += len(key)
        return self.flush() if self.held >= FLUSH_PAIRS else None

    def any_shard(self, n: int) -> np.ndarray:
        """Shards for ``n`` rows that may go anywhere, in runs."""
        self.turn += 1
        return (np.arange(n) // 4096 + self.turn * 7) % self.shards

    def flush(self) -> dict | None:
        if not self.held:
            return None
        key, member = distinct_pairs(np.concatenate(self.keys), np.concatenate(self.members))
        self.keys, self.members, self.held = [], [], 0
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        large = np.repeat(size >= self.local_group, size)
        send = ~large
        send[begin] = True
        out = [blobs(SENT, ((key[send] >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64), key[send], member[send])]
        if large.any():
            out.append(blobs(KNOWN, self.any_shard(int(large.sum())), key[large], member[large]))
        return concat(out)


def shared_pairs(batches: Iterator[pa.RecordBatch], extra: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, member) of the keys that several members share, from the packed rows of a partition; repeats are possible.

    Rows of the kind EXTRA are handed over in ``extra``.
    """
    keys, members = [], []
    for b in batches:
        for kind, a, m, c in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
            if kind == EXTRA:
                extra.append((a, m, c))
                continue
            a, m = np.frombuffer(a, np.uint64), np.frombuffer(m, np.uint64)
            if kind == KNOWN:
                yield a, m
            else:
                keys.append(a)
                members.append(m)
    if keys:
        key, member = distinct_pairs(np.concatenate(keys), np.concatenate(members))
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        both = same[1:] | same[:-1]
        if both.any():
            yield key[both], member[both]
