"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with those of its language by the
Jensen-Shannon distance (base 2, 0 to 1). The references hold all documents of a language; its common words are all
words with at least ``COMMON_SHARE`` of the language's words, so there are at most 1 / ``COMMON_SHARE`` of them.
A language is a code of two or three letters with at least ``LANGUAGE_SHARE`` of all words, so there are at most 1 / ``LANGUAGE_SHARE``
of them; every other document, those of rare languages and without a code included, is compared with the reference of all documents. The
number of references is thus bounded whatever the table's size, and they travel to the tasks by value.

Class histograms of short texts scatter, so their limit falls with length: ``MAX_CLASS_DISTANCE`` from ``FULL_CHARS`` characters on, more by the
root of the missing length below. Under ``MIN_CHARS`` characters or ``MIN_WORDS`` words there is no distance.

Defined results: a null text counts as empty; an empty or short text has no distances and is judged by the base rules
alone; repeated rows are judged alike; without a word in the whole table there are no references and no distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.text import BLANK, NOT_LETTER, Hasher, covered, grams, map_runs, mix, to_long
from voxelframe.session import cut

COMMON_SHARE = 0.002
LANGUAGE_SHARE = 0.005
MIN_CHARS = 100
FULL_CHARS = 400
MIN_WORDS = 60
MAX_CLASS_DISTANCE = 0.20
MAX_WORD_DISTANCE = 0.42

CLASSES = 8  # a-z, A-Z, 0-9, blanks, sentence marks, other ASCII, symbols, beyond ASCII
CLASS = np.full(256, 5, np.uint8)
CLASS[97:123] = 0
CLASS[65:91] = 1
CLASS[48:58] = 2
CLASS[BLANK] = 3
CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
CLASS[[ord(c) for c in "#$%&*"]] = 6
CLASS[192:] = 7
INSIDE = 8  # of a character
CLASS[128:192] = INSIDE
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def language(column: str = "lang"):
    c = F.lower(F.col(f"`{column}`").cast("string"))
    return F.when(c.rlike("^[a-z]{2,3}$"), c).otherwise("")


def _classes(t) -> np.ndarray:
    """Counts of character classes by document."""
    of = np.repeat(np.arange(len(t), dtype=np.int64), np.diff(t.offs))
    return np.bincount(of * 9 + CLASS[t.buf], minlength=9 * len(t)).reshape(-1, 9)[:, :CLASSES]


def _letter_words(hasher, t):
    r = t.lower().ranges(NOT_LETTER)
    return r, hasher.ranges(r)


def language_counts(docs: DataFrame) -> DataFrame:
    """lang, kind (0 class, 1 word), key (class or word hash), n: sums over all documents, from (lang, text)."""

    def count(state, rows, t):
        hasher, words, classes = state
        langs = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
        of = langs.indices.to_numpy(zero_copy_only=False)
        r, h = _letter_words(hasher, t)
        by_class = _classes(t)
        for i, name in enumerate(langs.dictionary.to_pylist()):
            classes[name] = classes.get(name, 0) + by_class[of == i].sum(axis=0)
            keys, n = np.unique(h[of[r.of] == i], return_counts=True)
            words.setdefault(name, []).append((keys, n))
            if sum(len(k) for k, _ in words[name]) > 400_000:
                words[name] = [_merged(words[name])]

    def end(state):
        _, words, classes = state
        out = {"lang": [], "kind": [], "key": [], "n": []}
        for name in classes:
            keys, n = _merged(words[name])
            out["lang"] += [name] * (CLASSES + len(keys))
            out["kind"].append(np.repeat([0, 1], [CLASSES, len(keys)]))
            out["key"].append(np.concatenate((np.arange(CLASSES), to_long(keys))))
            out["n"].append(np.concatenate((classes[name], n)))
        if out["lang"]:
            return {k: v if k == "lang" else np.concatenate(v) for k, v in out.items()}

    parts = map_runs(docs, "text", count, "lang string, kind int, key long, n long", lambda: (Hasher(), {}, {}), end)
    return parts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def _merged(parts):
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def references(docs: DataFrame, common_share: float = COMMON_SHARE, language_share: float = LANGUAGE_SHARE) -> dict:
    """lang -> (class histogram, sorted hashes of common words, word histogram with all other words last); '' is that of all documents."""
    counts = cut(language_counts(docs))  # read several times
    totals = counts.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    every = totals.agg(F.sum("total")).first()[0] or 0
    own = counts.join(totals.filter((F.col("lang") != "") & (F.col("total") >= language_share * every)), "lang").select("lang", "kind", "key", "n", "total")
    shared = counts.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "kind", "key", "n", F.lit(every).alias("total"))
    parts = [x.filter((F.col("total") > 0) & ((F.col("kind") == 0) | (F.col("n") >= F.col("total") * common_share))) for x in (own, shared)]
    # at most 1 / language_share + 1 languages, each of at most 1 / common_share words
    rows = parts[0].collect() + parts[1].collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r.lang, ({}, {}, r.total))[r.kind][r.key] = r.n
    out = {}
    for name, (classes, words, total) in found.items():
        keys = np.array(sorted(words), np.int64)
        n = np.array([words[k] for k in keys.tolist()] + [total - sum(words.values())], float)
        c = np.array([classes.get(k, 0) for k in range(CLASSES)], float)
        out[name] = (c / c.sum(), keys, n / total)
    return out


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from one distribution."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def base_counts(hasher: Hasher, t) -> dict:
    """Word, symbol, repeated line and repeated window counts by document."""
    r = t.words()
    n_words = r.per_document()
    chars = np.concatenate(([0], np.cumsum(CLASS[t.buf] != INSIDE, dtype=np.int64)))
    h = hasher.ranges(r)
    word_chars = np.bincount(r.of, chars[r.ends] - chars[r.starts], len(t)).astype(np.int64)
    lines = t.lines()
    body = np.concatenate(([0], np.cumsum(~BLANK[t.buf])))
    full = body[lines.ends] > body[lines.starts]
    of = lines.of[full]
    keys = mix(hasher.ranges(lines)[full] + of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    first = np.unique(keys, return_index=True)[1]
    n_lines, n_first = np.bincount(of, minlength=len(t)), np.bincount(of[first], minlength=len(t))
    g, at = grams(h, r.of, 5)
    keys = mix(g + r.of[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    again = at[order[same[1:] | same[:-1]]]
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": t.per_document(SYMBOL[t.buf]), "n_dup_lines": n_lines - n_first,
        "n_repeat_words": np.bincount(r.of[covered(again, 5, len(r))], minlength=len(t)),
    }


VERDICTS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "class_distance double, word_distance double, base_failed boolean, kept boolean"
)


def _judge(refs: dict, min_chars: int, min_words: int, max_class: float, max_word: float):
    def judge(hasher, rows, t):
        out = base_counts(hasher, t)
        langs = rows.column(rows.schema.get_field_index("lang")).to_pylist()
        langs = np.array([x if x in refs else "" for x in langs], object)
        classes = _classes(t)
        n_chars = classes.sum(axis=1)
        r, h = _letter_words(hasher, t)
        h = to_long(h)
        n_letter_words = r.per_document()
        class_d, word_d = np.full(len(t), np.nan), np.full(len(t), np.nan)
        for name in set(langs.tolist()) & refs.keys():
            ref_c, keys, ref_w = refs[name]
            of = langs == name
            long_ = of & (n_chars >= min_chars)
            class_d[long_] = js_distance(classes[long_], ref_c)
            wordy = np.flatnonzero(of & (n_letter_words >= min_words))
            if not len(wordy):
                continue
            row = np.full(len(t), -1)
            row[wordy] = np.arange(len(wordy))
            mine = row[r.of] >= 0
            x = h[mine]
            slot = np.searchsorted(keys, x)
            slot = np.where(slot < len(keys), np.where(keys[np.minimum(slot, len(keys) - 1)] == x, slot, len(keys)), len(keys)) if len(keys) else np.zeros(len(x), int)
            width = len(keys) + 1
            counts = np.bincount(row[r.of[mine]] * width + slot, minlength=len(wordy) * width).reshape(-1, width)
            word_d[wordy] = js_distance(counts, ref_w)
        n = out["n_words"]
        out["base_failed"] = (n < 10) | (100 * out["n_repeat_words"] > 20 * n)
        limit = max_class * np.sqrt(np.maximum(1, FULL_CHARS / np.maximum(n_chars, 1)))
        out["kept"] = ~out["base_failed"] & ~(class_d > limit) & ~(word_d > max_word)
        out["class_distance"], out["word_distance"] = pa.array(class_d, from_pandas=True), pa.array(word_d, from_pandas=True)
        return out

    return judge


def quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", common_share: float = COMMON_SHARE,
    language_share: float = LANGUAGE_SHARE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """A verdict for every row. Distances are null below the length guards."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), language(lang).alias("lang"))
    refs = references(slim.select("lang", "text"), common_share, language_share)
    judge = _judge(refs, min_chars, min_words, max_class_distance, max_word_distance)

    def with_id(hasher, rows, t):
        return judge(hasher, rows, t) | {"doc_id": rows.column(0)}

    return map_runs(slim, "text", with_id, VERDICTS, Hasher)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", **settings) -> DataFrame:
    """The rows of the table, all columns as they are, that pass :func:`quality` with these settings."""
    s = dict(common_share=COMMON_SHARE, language_share=LANGUAGE_SHARE, min_chars=MIN_CHARS, min_words=MIN_WORDS, max_class_distance=MAX_CLASS_DISTANCE, max_word_distance=MAX_WORD_DISTANCE) | settings
    slim = docs.select(language(lang).alias("lang"), F.col(f"`{text}`").alias("text"))
    refs = references(slim, s["common_share"], s["language_share"])
    judge = _judge(refs, s["min_chars"], s["min_words"], s["max_class_distance"], s["max_word_distance"])
    names = [f"c{i}" for i in range(len(docs.columns))]
    fields = docs.schema.fields
    tagged = docs.toDF(*names).withColumn("lang", language(names[docs.columns.index(lang)]))
    body = names[docs.columns.index(text)]

    def keep(hasher, rows, t):
        good = np.flatnonzero(judge(hasher, rows, t)["kept"])
        if len(good):
            kept = rows.take(pa.array(good))
            return {n: kept.column(i) for i, n in enumerate(names)}

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields))
    return map_runs(tagged, body, keep, schema, Hasher).toDF(*docs.columns)
