"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 hashes have it. Texts whose fingerprints differ in
at most ``RADIUS`` bits are linked.

Only distinct fingerprints are compared. Of ``RADIUS + 1`` blocks of bits a linked pair agrees in one, so fingerprints meet in
cells: a block and its value. A cell with more than ``LIMIT`` members is split by the same rule over the bits it has not used yet, so no
pair is lost; after ``LEVELS`` splits at most 16 bits are left, which bounds a cell whatever the table holds. Cells
come sorted to a task and are laid out as bit planes, 64 fingerprints to a word. A fingerprint is compared with all words of its
cell at once: the planes are read one by one, the differences of 64 pairs at a time go to carry-save counters, and words whose 64
counters have all passed the radius are abandoned every few planes. A cell gives a tree of links for each of its
components, not its pairs; the components of all cells are joined in rounds.

Rows of a fingerprint that very many documents hold are dealt by a salt when the components are attached.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer words than a
shingle has are one shingle; rows with the same id are judged by their own texts; a null id is no component's name while a
member with an id exists; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.text import Texts, map_runs, only, spread, to_long
from voxelframe.plans.graph import connected_components
from voxelframe.session import cut

WIDTH = 3
SEED = 42
RADIUS = 3
LIMIT = 2048
LEVELS = 5
SALTS = 16
ALL = np.uint64(2**64 - 1)


def shingle_hashes(t: Texts, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts, repeats included, and the document of each."""
    from xxhash import xxh64_intdigest

    r = t.lower().words()
    n = r.per_document()
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    of = np.repeat(np.arange(len(t)), count)
    first = spread(np.cumsum(n) - n, count)
    last = first + np.minimum(width, n)[of] - 1
    # the words of the run with one blank behind each
    lens = r.ends - r.starts
    begin = np.cumsum(lens + 1) - lens - 1
    joined = np.full(int((lens + 1).sum()), 32, np.uint8)
    joined[spread(begin, lens)] = r.texts.buf[spread(r.starts, lens)]
    data, a, b = joined.tobytes(), begin[first], (begin + lens)[last]
    h = np.empty(len(of), np.uint64)
    for lo in range(0, len(of), 1 << 17):
        part = slice(lo, lo + (1 << 17))
        h[part] = np.fromiter((xxh64_intdigest(data[x:y], seed) for x, y in zip(a[part].tolist(), b[part].tolist())), np.uint64)
    return h, of


def majority(h: np.ndarray, of: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document the bits that more than half of its hashes have. ``of`` ascends."""
    out = np.zeros(n_docs, np.uint64)
    if not len(h):
        return out
    total = np.bincount(of, minlength=n_docs)
    # four 16-bit sums in a word: no stretch is longer than such a sum can count
    place = np.arange(len(of)) - (np.cumsum(total) - total)[of]
    starts = np.flatnonzero(place % 65535 == 0)
    lanes = np.uint64(0x0001000100010001)
    for j in range(16):
        sums = np.add.reduceat((h >> np.uint64(j)) & lanes, starts)
        for k in range(0, 64, 16):
            votes = np.bincount(of[starts], (sums >> np.uint64(k)) & np.uint64(0xFFFF), n_docs)
            out |= (2 * votes > total).astype(np.uint64) << np.uint64(j + k)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long) of every row."""
    slim = only(docs, doc_id=doc_id, text=text)

    def run(_, rows, t):
        return {"doc_id": rows.column(0), "fp": to_long(majority(*shingle_hashes(t, width, seed), len(t)))}

    return map_runs(slim, "text", run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: word ``w`` of plane ``p`` has bit ``p`` of the fingerprints 64 w to 64 w + 63."""
    words = -(-len(fp) // 64)
    padded = np.zeros(words * 64, "<u8")
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(words, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(64, words)


def close_pairs(fp: np.ndarray, ends: np.ndarray, radius: int = RADIUS, same: int = 0, step: int = 1 << 15, every: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j < ends[i], of fingerprints at most ``radius`` bits apart, in parts.

    ``same``: bits that all compared pairs share. ``step``: how many words are compared at once; after ``every`` planes
    the words in which no pair is left are abandoned.
    """
    table = planes(fp)
    used = [p for p in range(64) if not same >> p & 1]
    k = radius.bit_length()
    rows = np.arange(len(fp))
    first = (rows + 1) // 64
    n_words = np.where(ends > rows + 1, (ends - 1) // 64 - first + 1, 0)
    cuts = np.searchsorted(np.cumsum(n_words), np.arange(0, n_words.sum() + step, step))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(fp))):
        q = np.repeat(rows[lo:hi], n_words[lo:hi])
        if not len(q):
            continue
        w = spread(first[lo:hi], n_words[lo:hi])
        low = np.clip(q + 1 - 64 * w, 0, 63).astype(np.uint64)
        high = np.clip(64 - (ends[q] - 64 * w), 0, 63).astype(np.uint64)
        over = ~((ALL << low) & (ALL >> high))
        # counters of k bits that begin so that radius + 1 differences overflow
        begin = (1 << k) - 1 - radius
        count = [np.full(len(q), ALL if begin >> b & 1 else 0, np.uint64) for b in range(k)]
        x = fp[q]
        for done, p in enumerate(used, 1):
            carry = table[p][w] ^ (np.uint64(0) - (x >> np.uint64(p) & np.uint64(1)))
            for b in range(k):
                count[b], carry = count[b] ^ carry, count[b] & carry
            over |= carry
            if done % every == 0:
                live = np.flatnonzero(over != ALL)
                if len(live) < len(q):
                    q, w, x, over, count = q[live], w[live], x[live], over[live], [c[live] for c in count]
                    if not len(q):
                        break
        at, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        if len(at):
            yield q[at], 64 * w[at] + lane


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` places the first place of its component."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            live = a != b
            if not live.any():
                break
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def submasks(mask: int, radius: int = RADIUS) -> list[int]:
    """``mask`` with each of ``radius + 1`` blocks of the bits outside it; a mask of all bits stays alone."""
    free = [p for p in range(64) if not mask >> p & 1]
    if not free:
        return [mask]
    parts = [x for x in np.array_split(free, radius + 1) if len(x)]
    return [mask | sum(1 << int(p) for p in x) for x in parts] if len(parts) > radius else [mask]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cell_trees(cells: DataFrame, radius: int) -> DataFrame:
    """src, dst: a tree of links for each component of each cell (mask, value, fp, node)."""
    node = cells.schema["node"].dataType.simpleString()
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links(t: pa.Table):
        fp = t.column("fp").to_numpy().view(np.uint64)
        mask, value = t.column("mask").to_numpy(), t.column("value").to_numpy()
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        ends = np.repeat(np.append(new, len(fp)), np.diff(np.concatenate(([0], new, [len(fp)]))))
        root = roots(len(fp), close_pairs(fp, ends, radius, int(np.bitwise_and.reduce(mask).view(np.uint64))))
        child = np.flatnonzero(root != np.arange(len(fp)))
        if len(child):
            nodes = t.column("node").combine_chunks()
            out = pa.table({"src": nodes.take(pa.array(child)), "dst": nodes.take(pa.array(root[child]))})
            yield from out.to_batches()

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < 1 << 16:
                continue
            t = pa.Table.from_batches(held)
            mask, value = t.column("mask").to_numpy(), t.column("value").to_numpy()
            last = int(np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))[-1])
            if last:  # all but the cell at the end are whole
                yield from links(t.slice(0, last))
                held = t.slice(last).combine_chunks().to_batches()
                size = t.num_rows - last
        if size:
            yield from links(pa.Table.from_batches(held))

    # a fixed number of partitions: the work is in comparing, not in bytes
    dealt = cells.repartition(n, "mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.mapInArrow(run, f"src {node}, dst {node}")


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """src, dst: links between nodes whose fingerprints are at most ``radius`` bits apart, enough to connect all that are connected.

    ``nodes``: fp (long, distinct) and node, what the links are to name.
    """
    spark = nodes.sparkSession
    masks = submasks(0, radius)
    level = 1
    cells = nodes.select("fp", "node", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    out = None
    while True:
        last = level >= levels or masks == sorted({m for mask in masks for m in submasks(mask, radius)})
        small, big = cells, None
        if not last:
            # counts combine before the shuffle; the full cells meet their rows under a salt
            full = cut(cells.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("mask", "value"))
            if full.take(1):
                salted = full.select("mask", "value", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
                at = ["mask", "value", "salt"]
                tagged = cells.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
                small = tagged.join(salted, at, "left_anti").drop("salt")
                big = tagged.join(salted, at, "left_semi").drop("salt")
        trees = _cell_trees(small, radius)
        out = trees if out is None else out.unionByName(trees)
        if big is None:
            return out
        # at most (radius + 1) ** levels rows
        children = spark.createDataFrame([(_signed(m), _signed(c)) for m in masks for c in submasks(m, radius)], "mask long, child long")
        cells = big.join(F.broadcast(children), "mask").select("fp", "node", F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("value"))
        cells = cut(cells)
        masks = sorted({c for m in masks for c in submasks(m, radius)})  # two ways may lead to a mask; a row met twice does no harm
        level += 1


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, radius: int = RADIUS, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """doc_id, fp, component_id (smallest id that links reach, itself included) of every row."""
    prints = cut(fingerprints(docs, doc_id, text, width, seed))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    node = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("first"), F.col("fp").alias("fp"))
    joined = connected_components(links(classes.select("fp", node.alias("node")), radius, limit, levels))
    joined = joined.select(F.col("node.fp").alias("fp"), F.col("component.first").alias("reached"), F.lit(True).alias("linked"))
    shared = classes.join(joined, "fp", "left").filter("n > 1 or linked").select("fp", F.when(F.col("linked"), F.col("reached")).otherwise(F.col("first")).alias("reached"))
    salted = shared.select("fp", "reached", F.lit(True).alias("is_shared"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    found = dealt.join(salted, ["fp", "salt"], "left")
    return found.select("doc_id", "fp", F.when(F.col("is_shared"), F.col("reached")).otherwise(F.col("doc_id")).alias("component_id"))
