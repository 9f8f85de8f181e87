"""Exact similarity join on n-gram sets: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

A document's set holds the hashes of its word n-grams; documents with equal sets are one class, of which only counts travel on.
Sets of linked classes differ in at most ``k`` members, a number that follows from their sizes. So classes are dealt by
size into bands, each set of a band is split by hash into ``k + 1 + e`` parts, and two linked sets agree in at least ``e + 1`` of
them: a tile holds the classes of a band with the same part. A class also enters the band below if a partner there may be
that small. Very small sets, which may differ in one member, have tiles of themselves and of themselves less each member. Empty
parts make no tile; a set with more than ``e`` of them, rare by the choice of ``e``, has tiles for these too. No link between
different sets can escape the tiles, and what merely shares a common passage doesn't meet in one.

Tiles are resolved in two rounds, so that a large group of copies costs no pairs: first every member with the tile's centre,
then, where a tile still holds several components, members of different components in cells of bounded size. A pair is a
candidate if the bit counts of the two signatures leave room for enough overlap; candidates are checked by intersecting the
sorted arrays. Components are those of all verified links.

Keys travel as packed arrays, and a task settles what it can of a large tile before it sends anything.

Defined results: null or empty texts have no set, no links and are their own component; repeated rows are in one class; a null id
gets its component's smallest id, null if there is none; documents with fewer than ``width`` words have one member, all their words.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.shared import EXTRA, PACKED, Packer, blobs, concat, shared_pairs
from voxelframe.llm.text import Hasher, Texts, grams, map_runs, mix, only, sized, to_long
from voxelframe.plans.graph import connected_components
from voxelframe.session import cut

PERCENT = 85
WIDTH = 4
GROWTH = 1.6
PIECE_BYTES = 8 << 20
SHARDS = 16
LOCAL_GROUP = 8
FEW_IDS = 1_000_000
CELL = 1024
WORDS_BAND, EMPTY = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Bands:
    """Bands of set sizes, from the first that allows two differences, with the number of parts of each."""

    def __init__(self, percent: int = PERCENT):
        if not 65 <= percent <= 100:
            raise ValueError("a band must reach further than the partners of its sizes")
        self.percent, self.low, self.parts, self.spare = percent, [], [], []
        self.at = self.small(percent)
        self.grow(self.at + 1)

    @staticmethod
    def small(percent: int) -> int:
        """The smallest size that may differ from a partner in more than one member."""
        n = 1
        while Bands.differ(n, n * 100 // percent, percent) <= 1:
            n += 1
        return n

    @staticmethod
    def differ(a: int, b: int, percent: int) -> int:
        """Most members that linked sets of these sizes can differ in."""
        return int(Fraction(100 - percent, 100 + percent) * (a + b))

    def grow(self, size: int) -> None:
        while not self.low or self.at <= size:
            low, self.at = self.at, max(self.at + 1, int(self.at * GROWTH))
            k = self.differ(self.at - 1, (self.at - 1) * 100 // self.percent, self.percent)
            e = 2 + k // 8
            self.low.append(low)
            self.parts.append(k + 1 + e)
            self.spare.append(e)

    def of(self, n: np.ndarray) -> np.ndarray:
        self.grow(int(n.max(initial=0)))
        return np.searchsorted(np.array(self.low), n, "right") - 1


def sets_of(hasher: Hasher, t: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all documents, one after the other, and where each document's begin."""
    r = t.lower().words()
    h = hasher.ranges(r)
    n = r.per_document()
    g, at = grams(h, r.of, width)
    of = r.of[at]
    b = r.bounds()
    extra_of = np.flatnonzero((n > 0) & (n < width))
    if len(extra_of):
        whole = [mix(np.array([_fold(h[b[i] : b[i + 1]])], np.uint64) + np.uint64(n[i]))[0] for i in extra_of.tolist()]
        g, of = np.concatenate((g, np.array(whole, np.uint64))), np.concatenate((of, extra_of))
        order = np.argsort(of, kind="stable")
        g, of = g[order], of[order]
    bounds = np.searchsorted(of, np.arange(len(t) + 1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo > 1:
            g[lo:hi].sort()
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return g[first], np.searchsorted(of[first], np.arange(len(t) + 1))


def _fold(h: np.ndarray) -> int:
    x = 0
    for v in h.tolist():
        x = (x * 0x9FB21C651E98DF25 + v + 1) % 2**64
    return x


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
    return c[bounds[1:]] - c[bounds[:-1]]


def class_digest(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return mix(sums(mix(g ^ WORDS_BAND), bounds) + np.diff(bounds).astype(np.uint64))


def tile_keys(g: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(tile, document) of all documents with these sets; see the module text."""
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(n)), n)
    mixed = mix(g ^ WORDS_BAND)
    percent = bands.percent
    keys, docs = [], []
    first = bands.low[0]
    # one member more or less: the set itself, and the set less each member
    whole = sums(mixed, bounds)
    at = np.flatnonzero((n > 0) & (n < first) & (100 * n >= percent * (n + 1)))
    keys.append(mix(whole[at] + np.uint64(1)))
    docs.append(at)
    member = ((n > 1) & (n <= first) & (100 * (n - 1) >= percent * n))[of]
    keys.append(mix(whole[of[member]] - mixed[member] + np.uint64(1)))
    docs.append(of[member])
    # parts
    bands.grow(int(n.max(initial=0)))
    low, parts, spare = np.array(bands.low), np.array(bands.parts), np.array(bands.spare)
    own = np.where(n >= first, bands.of(n), -1)
    below = own - 1
    for which in (own, np.where((below >= 0) & (n * percent < low[np.maximum(own, 0)] * 100), below, -1)):
        chosen = np.flatnonzero(which >= 0)
        if not len(chosen):
            continue
        m = np.zeros(len(n), np.int64)
        m[chosen] = parts[which[chosen]]
        start = np.cumsum(m) - m
        mine = m[of] > 0
        d = of[mine]
        slot = start[d] + (mixed[mine] >> np.uint64(33)).astype(np.int64) % m[d]
        total = int(m.sum())
        acc, count = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        np.add.at(acc, slot, mix(mixed[mine] + np.uint64(7)))
        doc = np.repeat(np.arange(len(n)), m)
        number = (np.arange(total) - start[doc]).astype(np.uint64) + which[doc].astype(np.uint64) * np.uint64(1 << 32)
        tile = mix(acc + mix(number + WORDS_BAND))
        empty = count == 0
        tile[empty] = mix(number[empty] ^ EMPTY)
        n_empty = np.bincount(doc[empty], minlength=len(n))
        wanted = ~empty | (n_empty[doc] > spare[np.maximum(which, 0)][doc])
        keys.append(tile[wanted])
        docs.append(doc[wanted])
    return np.concatenate(keys), np.concatenate(docs)


def bitmap_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of a signature: four to eight bits per member, a power of two."""
    return 1 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 16))).astype(np.int64)


def bitmaps(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, one after the other, and where each begins: bit ``mix(member) mod bits`` set for each member."""
    n = np.diff(bounds)
    words = bitmap_words(n)
    begin = np.concatenate(([0], np.cumsum(words)))
    bits = np.repeat((64 * words - 1).astype(np.uint64), n)
    at = mix(g ^ EMPTY) & bits
    out = np.zeros(int(begin[-1]), np.uint64)
    np.bitwise_or.at(out, np.repeat(begin[:-1], n) + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out, begin


def bitmap(s: np.ndarray) -> np.ndarray:
    return bitmaps(s, np.array([0, len(s)]))[0]


def folded(b: np.ndarray, w: int) -> np.ndarray:
    """A signature (or rows of them) at a smaller width."""
    while b.shape[-1] > w:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def room(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: members whose bit the other lacks aren't shared."""
    only_a, only_b = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def enough(inter, n_a, n_b, percent: int):
    return 100 * inter >= percent * (n_a + n_b - inter)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


# kind 0: tile x holds class y; kind 1: document x has class y, a set of n members with this signature
STAGED = "kind int, x long, y long, n int, signature binary"


def _gather(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Tiles with at least two classes, and the class of every document; one pass over the texts."""
    pieces = sized(docs, PIECE_BYTES)
    shards = max(512, SHARDS * pieces)

    def run(state, rows, t):
        hasher, bands, packer = state
        g, bounds = sets_of(hasher, t, width)
        cls = class_digest(g, bounds)
        key, doc = tile_keys(g, bounds, bands)
        known = pc.is_valid(rows.column(0)).to_numpy(zero_copy_only=False)
        ids = rows.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        size = np.diff(bounds)
        signatures, _ = bitmaps(g, bounds)
        row = {"kind": np.array([EXTRA]), "shard": packer.any_shard(1)}
        parts = (ids.tobytes(), cls.tobytes() + signatures.tobytes(), np.where(known, size, -size - 1).tobytes())
        row |= {c: pa.array([x], pa.large_binary()) for c, x in zip("abc", parts)}
        return concat([row, packer.add(key, cls[doc])])

    packed = map_runs(docs, "text", run, PACKED, lambda: (Hasher(), Bands(percent), Packer(shards, LOCAL_GROUP)), lambda s: s[2].flush())

    def settle(batches):
        names = ["kind", "x", "y", "n", "signature"]
        extra: list = []
        for key, cls in shared_pairs(batches, extra):
            m = len(key)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(key.view(np.int64)), pa.array(cls.view(np.int64)), pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.binary())], names)
        for ids, rest, n in extra:
            n = np.frombuffer(n, np.int64)
            m, null = len(n), n < 0
            n = np.where(null, -n - 1, n)
            offs = np.concatenate(([0], np.cumsum(bitmap_words(n)))) * 8
            signature = pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(rest[8 * m :])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int32)), pa.array(np.frombuffer(ids, np.int64), mask=null), pa.array(np.frombuffer(rest, np.int64, m)), pa.array(n.astype(np.int32)), signature.cast(pa.binary())], names
            )

    return packed.repartition(pieces, "shard").mapInArrow(settle, STAGED)


def _possible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and signatures leave room for a link."""
    left = signatures.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    right = signatures.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    def check(batches):
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                if enough(int(room(folded(x, w), folded(y, w), n_a[i], n_b[i])), int(n_a[i]), int(n_b[i]), percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(left, "a").join(right, "b").filter(fits).select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(check, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("set_b"))

    def check(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if enough(overlap(x, y), len(x), len(y), percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cls, members (sorted hashes) of the wanted classes, from one document each."""
    ids = cut(classes.join(wanted, "cls").select(F.col("doc_id").alias("id")).distinct())
    if ids.count() <= FEW_IDS:  # then the texts needn't be shuffled
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select("text")

    def run(hasher, rows, t):
        g, bounds = sets_of(hasher, t, width)
        data = pa.Array.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(g)])
        return {"cls": to_long(class_digest(g, bounds)), "members": data}

    return map_runs(texts, "text", run, "cls long, members binary", Hasher).join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _cells(members: DataFrame, component: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs with room for a link between members of different components of a tile, by cells of tiles.

    Tiles of two are left out: their only pair is that with the centre.
    """
    placed = members.join(component, members.y == component.node, "left").select("x", "y", F.coalesce("component", "y").alias("comp"))
    sizes = placed.groupBy("x").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m"))
    mixed = cut(sizes.filter("c0 != c1 and m > 2").select("x", F.ceil(F.col("m") / CELL).cast("int").alias("cells")))
    rows = (
        placed.join(mixed, "x").join(signatures.select(F.col("cls").alias("y"), "n", "signature"), "y")
        .withColumn("cell", F.pmod(F.xxhash64("y"), F.col("cells")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .select("x", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "y", "comp", "n", "signature")
    )
    keys = ["x", "i", "j"]

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            x = np.stack([t.column(c).to_numpy() for c in keys])
            begin = np.flatnonzero(np.concatenate(([True], (x[:, 1:] != x[:, :-1]).any(axis=0)))) if len(t) else np.zeros(0, np.int64)
            if len(begin) > 1:  # the last cell may go on
                yield _cell_pairs(t.slice(0, begin[-1]), begin, percent)
                held = t.slice(begin[-1]).to_batches()
        t = pa.Table.from_batches(held) if held else None
        if t is not None and len(t):
            x = np.stack([t.column(c).to_numpy() for c in keys])
            begin = np.flatnonzero(np.concatenate(([True], (x[:, 1:] != x[:, :-1]).any(axis=0))))
            yield _cell_pairs(t, np.append(begin, len(t)), percent)

    # a cell holds at most about two times CELL classes
    pairs = rows.repartition(*keys).sortWithinPartitions(*keys, "n", "y").mapInArrow(compare, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _cell_pairs(t: pa.Table, begin: np.ndarray, percent: int) -> pa.RecordBatch:
    """Possible pairs of the cells that begin at these rows; rows of a cell are sorted by size."""
    i, j, cell, y, comp, n = (t.column(c).to_numpy() for c in ("i", "j", "cell", "y", "comp", "n"))
    n = n.astype(np.int64)
    maps = [np.frombuffer(m, np.uint64) for m in t.column("signature").to_pylist()]
    width = np.array([len(m) for m in maps])
    out_a, out_b = [], []
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
        for p in range(lo, hi):
            # the partners of a size band: up to the largest that can be linked, each pair from its smaller side
            q = np.arange(p + 1, lo + int(np.searchsorted(n[lo:hi], n[p] * 100 // percent, "right")))
            q = q[(comp[q] != comp[p]) & ((cell[q] != cell[p]) if i[p] != j[p] else True)]
            for w in np.unique(width[q]).tolist():
                at = q[width[q] == w]
                v = min(w, len(maps[p]))
                both = folded(np.stack([maps[k] for k in at.tolist()]), v)
                good = at[enough(room(both, folded(maps[p], v), n[at], n[p]), n[at], n[p], percent)]
                out_a += [y[p]] * len(good)
                out_b += y[good].tolist()
    return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and class_id: rows with equal sets have the same."""
    return _placed(docs, doc_id, text, percent, width).drop("component")


def _placed(docs: DataFrame, doc_id: str, text: str, percent: int, width: int) -> DataFrame:
    """The columns of :func:`components`, and component: components with the same smallest id are told apart; null for empty sets."""
    slim = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    staged = cut(_gather(slim, width, percent))
    rows = staged.filter("kind = 1").select(F.col("x").alias("doc_id"), F.col("y").alias("cls"), "n")
    described = cut(staged.filter("kind = 1 and n > 0").groupBy(F.col("y").alias("cls")).agg(F.min("x").alias("doc_id"), F.max("n").alias("n"), F.max("signature").alias("signature")))
    classes, signatures = described.select("cls", "doc_id"), described.select("cls", "n", "signature")
    # a class that agrees in many tiles is near the middle of its group: the centre of a tile is the one with the most
    pairs_ = cut(staged.filter("kind = 0").select("x", "y").distinct())
    degree = cut(pairs_.groupBy("y").agg(F.count(F.lit(1)).alias("degree")))
    ranked = pairs_.join(degree, "y").select("x", "y", F.struct(-F.col("degree"), F.col("y").alias("y")).alias("order"))
    # tiles with the same members, as all those of two near copies, are one
    digest = [F.count(F.lit(1)), F.expr("bit_xor(xxhash64(y))"), F.expr("bit_xor(xxhash64(y, 1))")]
    tiles = ranked.groupBy("x").agg(F.min("order").alias("o"), *[d.alias(f"d{i}") for i, d in enumerate(digest)]).filter("d0 > 1")
    centres = cut(tiles.groupBy("d0", "d1", "d2").agg(F.min(F.struct("x", F.col("o.y").alias("centre"))).alias("t")).select("t.*"))
    members = cut(pairs_.join(centres, "x"))
    stars = members.filter("y != centre").select(F.least("centre", "y").alias("a"), F.greatest("centre", "y").alias("b")).distinct()
    pairs = cut(_possible(stars, signatures, percent))
    members = members.select("x", "y")
    sets = cut(_sets(slim, classes, _ends(pairs), width))
    links = cut(_verify(pairs, sets, percent))
    component = cut(connected_components(links, "a", "b"))
    more = cut(_cells(members, component, signatures, percent))
    if not more.isEmpty():
        known = sets.select("cls")
        rest = cut(_sets(slim, classes, _ends(more).join(known, "cls", "left_anti"), width))
        links = links.unionByName(cut(_verify(more, sets.unionByName(rest), percent)))
        component = cut(connected_components(links, "a", "b"))
    of_class = cut(classes.join(component, classes.cls == component.node, "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("component")))
    lows = cut(of_class.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    found = cut(of_class.join(lows, "component").select("cls", "component", "component_id"))
    return rows.join(found, "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cls").alias("class_id"), "component",
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of the table, all columns as they are, without near duplicates.

    Of each component the row with its smallest id stays; of rows of the component that repeat this id, the one with the smallest
    text hash, and of whole copies one. Rows without an id stay, and so do rows without a set, copies of their id and text excepted.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, body = names[docs.columns.index(doc_id)], names[docs.columns.index(text)]
    tagged = docs.toDF(*names).withColumn("id", F.col(key).cast("long"))
    found = cut(_placed(docs, doc_id, text, percent, width).filter("doc_id is not null"))
    lowest = found.filter("doc_id = component_id")
    # ids whose rows have different sets: the set of each row is made once more to tell which component it is in
    several = found.groupBy("doc_id").agg(F.min("class_id").alias("c0"), F.max("class_id").alias("c1")).filter("c0 != c1").select(F.col("doc_id").alias("id"))
    several = cut(several)
    keep = lowest.select(F.col("doc_id").alias("id")).distinct().join(several, "id", "left_anti")
    # the limit to one row per id works before the shuffle, so a much repeated id is no large group
    first = Window.partitionBy("id").orderBy(F.xxhash64(body))
    once = tagged.filter("id is not null").withColumn("place", F.row_number().over(first)).filter("place = 1")
    out = once.join(keep, "id").select(*names).unionByName(tagged.filter("id is null").select(*names))
    if not several.isEmpty():
        classes = lowest.join(several, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), F.col("class_id").alias("cls"), "component").distinct()
        mixed = tagged.join(several, "id").select("id", *names)

        def run(hasher, rows, t):
            g, bounds = sets_of(hasher, t, width)
            return {c: rows.column(i) for i, c in enumerate(rows.schema.names)} | {"cls": to_long(class_digest(g, bounds))}

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mixed.schema.fields) + ", cls long"
        of_component = Window.partitionBy("id", "component").orderBy(F.xxhash64(body))
        rows = map_runs(mixed, body, run, schema, Hasher).join(classes, ["id", "cls"]).withColumn("place", F.row_number().over(of_component))
        out = out.unionByName(rows.filter("place = 1").select(*names))
    return out.toDF(*docs.columns)
