"""Line deduplication by winnowing.

Each line with a word is hashed. Of every ``RUN`` consecutive lines the one with the smallest hash (the rightmost of equals) is a
fingerprint; two texts that share a run of ``RUN`` lines thus share its fingerprint. Fingerprints are joined by hash; only
places of fingerprints that occur twice go on. Each is extended both ways over the runs that chose it, and runs that
are equal are joined to their first place (smallest id, then text hash, then line). All later ones are deleted: what is left of
a longer match are its overlapping runs, so it goes as a whole.

Only hashes travel; the texts are shuffled once, to be rewritten. Counts per hash combine before the shuffle and are joined back under a
salt, so a line or run that a third of all documents hold is no single group.

A repeated run of fewer than ``RUN`` lines counts too if it has ``min_words`` words, so a long line or pair of
lines is found wherever it stands. Such runs are found and joined in the same way; their fingerprint is the smallest hash among their own lines.

Defined results: null and empty texts stay as they are; blank lines are no part of runs and stay while any line does; rows
with the same id and text count as one place and are treated alike; a null id comes first; texts with fewer than ``RUN`` lines
lose nothing but long lines; ``min_words`` None leaves all shorter runs alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.text import BLANK, Hasher, Texts, grams, map_runs, spread, to_long, window_minima
from voxelframe.session import cut

RUN = 3
MIN_WORDS = 13
SALTS = 8


def full_lines(t: Texts):
    """Lines with a word, and their places among all lines."""
    lines = t.lines()
    body = np.concatenate(([0], np.cumsum(~BLANK[t.buf])))
    at = np.flatnonzero(body[lines.ends] > body[lines.starts])
    return lines, at


def fingerprints(docs: DataFrame, run: int = RUN, min_words: int | None = MIN_WORDS) -> DataFrame:
    """doc_id, tie, print, runs (hashes), starts (``run`` times the first line of each run, plus its lines less one): one row per fingerprint of (doc_id, tie, text)."""

    def find(hasher, rows, t):
        lines, at = full_lines(t)
        h, of = hasher.ranges(lines)[at], lines.of[at]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(t)))))
        found = []
        if min_words is not None:
            words = t.words().starts
            before = np.append(np.searchsorted(words, lines.starts[at]), len(words))
            for k in range(1, run):
                g, first = grams(h, of, k)
                # no words stand between the full lines of a document
                long = np.flatnonzero(before[first + k] - before[first] >= min_words)
                found.append((g[long], first[long], k))
        found.append((*grams(h, of, run), run))
        g, first, size = (np.concatenate(x) for x in zip(*((g, f, np.full(len(f), k)) for g, f, k in found)))
        if not len(g):
            return None
        chosen = np.concatenate([window_minima(h, f, k) for _, f, k in found])
        order = np.argsort(chosen, kind="stable")
        anchors, count = np.unique(chosen, return_counts=True)
        offs = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
        doc = pa.array(of[anchors])
        starts = (first - bounds[of[first]]) * run + size - 1
        return {
            "doc_id": rows.column(0).take(doc), "tie": rows.column(1).take(doc), "print": to_long(h[anchors]),
            "runs": pa.ListArray.from_arrays(offs, pa.array(to_long(g[order]))),
            "starts": pa.ListArray.from_arrays(offs, pa.array(starts[order], pa.int32())),
        }

    return map_runs(docs, "text", find, "doc_id long, tie long, print long, runs array<long>, starts array<int>", Hasher)


def _salt():
    return F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)).cast("int")


def _salted(keys: DataFrame) -> DataFrame:
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def repeated_runs(docs: DataFrame, run: int = RUN, min_words: int | None = MIN_WORDS) -> DataFrame:
    """doc_id, tie, starts: where (among lines with a word) a run begins that has an earlier place, and its length, as in :func:`fingerprints`."""
    prints = fingerprints(docs, run, min_words).withColumn("salt", _salt())
    twice = cut(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print"))
    places = prints.join(_salted(twice), ["print", "salt"]).select("doc_id", "tie", "salt", F.explode(F.arrays_zip("runs", "starts")).alias("r")).select(
        "salt", F.col("r.runs").alias("run"), F.struct("doc_id", "tie", F.col("r.starts").alias("start")).alias("place")
    )
    places = cut(places)
    firsts = places.groupBy("run").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select("run", "first")
    later = places.join(_salted(cut(firsts)), ["run", "salt"]).filter("place > first")
    return later.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.tie").alias("tie")).agg(F.collect_set("place.start").alias("starts"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, min_words: int | None = MIN_WORDS, counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """The table with repeated runs of lines deleted from its texts, all other columns as they are.

    ``min_words``: shorter runs of at least so many words go too. ``counts`` adds n_lines and n_removed (lines with a word); ``drop_emptied`` leaves out documents that lost all their lines.
    """
    names, fields = [f"c{i}" for i in range(len(docs.columns))], docs.schema.fields
    key, body = names[docs.columns.index(doc_id)], names[docs.columns.index(text)]
    tagged = docs.toDF(*names).withColumn("doc_id", F.col(key).cast("long")).withColumn("tie", F.xxhash64(body))
    again = repeated_runs(tagged.select("doc_id", "tie", F.col(body).alias("text")), run, min_words)
    again = again.select(F.col("doc_id").alias("r_id"), F.col("tie").alias("r_tie"), "starts")
    joined = tagged.join(again, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tie") == F.col("r_tie")), "left").select(*names, "starts")

    def rewrite(_, rows, t):
        lists = rows.column(rows.schema.get_field_index("starts"))
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        lines, at = full_lines(t)
        n_full = np.bincount(lines.of[at], minlength=len(t))
        bounds = np.cumsum(n_full) - n_full
        first, size = np.divmod(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), run)
        gone = np.zeros(len(at), bool)
        gone[spread(np.repeat(bounds, n) + first, size + 1)] = True
        removed = np.bincount(lines.of[at[gone]], minlength=len(t))
        texts = rows.column(rows.schema.get_field_index(body)).to_pylist()
        drop = np.zeros(len(lines), bool)
        drop[at[gone]] = True
        all_bounds = np.concatenate(([0], np.cumsum(np.bincount(lines.of, minlength=len(t)))))
        for i in np.flatnonzero(removed).tolist():
            keep = [k for k in range(all_bounds[i], all_bounds[i + 1]) if not drop[k]]
            left = removed[i] < n_full[i]
            texts[i] = b"\n".join(t.buf[lines.starts[k] : lines.ends[k]].tobytes() for k in keep).decode() if left else ""
        out = {c: rows.column(i) for i, c in enumerate(names)} | {body: pa.array(texts, pa.string()), "n_lines": n_full, "n_removed": removed}
        if drop_emptied:
            live = pa.array(np.flatnonzero((removed == 0) | (removed < n_full)))
            out = {c: (v if isinstance(v, pa.Array) else pa.array(v)).take(live) for c, v in out.items()}
        return out

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)) + ", n_lines long, n_removed long"
    out = map_runs(joined, body, rewrite, schema)
    return out.toDF(*docs.columns, "n_lines", "n_removed") if counts else out.select(*names).toDF(*docs.columns)
