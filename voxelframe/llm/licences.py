"""Licence scans: matching statistics of a generalised suffix automaton, chained into covered template spans.

The automaton holds the word sequences of all templates. A file's words are streamed through it; at each word it knows the
longest run ending there that stands somewhere in a template. Runs that can't grow and have at least ``MIN_MATCH`` words are
matches. Matches that follow each other in both the file and one template, with small gaps, form a chain; the words it covers,
as a share of the template, decide the label. Words that stand in no template end every run, so only stretches of at least
``MIN_MATCH`` template words are streamed; the rest can't hold a match.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned alike; ties between
chains go to the one that starts first.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelframe.llm.text import NOT_ALNUM, Hasher, map_runs, only, texts_of, to_long

MIN_MATCH = 4
MAX_GAP = 6
MIN_COVER = 0.6

# Phrases that are labels by themselves
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as licensors publish them, (label, text)
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


class SuffixAutomaton:
    """All substrings of several sequences, with every place where they end."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, c in enumerate(sequence):
                last = self._extend(last, c)
                self.ends[last].add((number, at + 1))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state reached from ``p`` by ``c``, for strings of exactly one word more than those of ``p``."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, c)
        return new

    def statistics(self, sequence: Iterable[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest run ending at each item."""
        state = length = 0
        out = []
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            else:
                length = 0
            out.append((length, state))
        return out


def chains(matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """Chains of matches (place in the file, place in the template, words): (first, last + 1, covered words), best first.

    A match may follow another if it begins after it in both, at most ``max_gap`` words later in the file; overlaps are cut.
    """
    matches = sorted(set(matches))
    best: list[tuple[int, int]] = []
    reach = max_gap + max((n for _, _, n in matches), default=0)
    for i, (f, t, n) in enumerate(matches):
        score, first = n, f
        for j in range(i - 1, -1, -1):
            fj, tj, nj = matches[j]
            if f - fj > reach:
                break
            if fj < f and tj < t and fj + nj < f + n and tj + nj < t + n and f - (fj + nj) <= max_gap:
                own = n - max(0, fj + nj - f, tj + nj - t)
                if own > 0 and (best[j][0] + own > score or (best[j][0] + own == score and best[j][1] < first)):
                    score, first = best[j][0] + own, best[j][1]
        best.append((score, first))
    ranked = sorted(range(len(matches)), key=lambda i: (-best[i][0], best[i][1], matches[i]))
    return [(best[i][1], matches[i][0] + matches[i][2], best[i][0]) for i in ranked]


def _words(text: str) -> list[bytes]:
    t = next(texts_of(pa.array([text]))).lower()
    r = t.ranges(NOT_ALNUM)
    return r.packed().to_pylist()


SCANNED = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:long,last:long,covered:long,share:double>>"
)


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER,
) -> DataFrame:
    """One row per row: phrase places, labels, the best cover of a template, and the spans found.

    The templates are a fixed list of the caller and travel to the tasks by value.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    template_words = [_words(x) for _, x in templates]
    phrase_words = [_words(x) for x in phrases]
    names, phrase_labels = [label for label, _ in templates], list(phrases.values())
    vocabulary = sorted({w for x in (*template_words, *phrase_words) for w in x})

    def make():
        hasher = Hasher()
        column = pa.array(vocabulary, pa.binary()).cast(pa.string())
        hashes = np.concatenate([to_long(hasher.ranges(t.ranges(NOT_ALNUM))) for t in texts_of(column)]) if vocabulary else np.zeros(0, np.int64)
        order = np.argsort(hashes)
        code = {w: i + 1 for i, w in enumerate(vocabulary)}
        automaton = SuffixAutomaton([[code[w] for w in x] for x in template_words])
        return hasher, hashes[order], order + 1, automaton, [[code[w] for w in x] for x in phrase_words]

    sizes = [len(x) for x in template_words]

    def run(state, rows, t):
        hasher, keys, codes, automaton, wanted = state
        r = t.lower().ranges(NOT_ALNUM)
        h = to_long(hasher.ranges(r))
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        code = np.where(keys[at] == h, codes[at], 0) if len(keys) else np.zeros(len(h), np.int64)
        bounds = r.bounds()
        n = len(t)
        found = [set() for _ in range(n)]
        n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: dict[int, set] = {}
        for x, label in zip(wanted, phrase_labels):
            m = len(code) - len(x) + 1
            if m <= 0 or not x:
                continue
            hit = r.of[:m] == r.of[len(x) - 1 :]
            for j, c in enumerate(x):
                hit &= code[j : j + m] == c
            p = np.flatnonzero(hit)
            d = r.of[p]
            n_base += np.bincount(d, minlength=n)
            np.minimum.at(first, d, p - bounds[d])
            np.maximum.at(last, d, p - bounds[d])
            for i in np.unique(d).tolist():
                base.setdefault(i, set()).add(label)
        known = code > 0
        edge = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
        begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        matches: dict[tuple[int, int], list] = {}
        inner = bounds[1:-1]
        for lo, hi in zip(begin.tolist(), end.tolist()) if len(code) else ():
            if hi - lo < min_match:
                continue
            cuts = inner[(inner > lo) & (inner < hi)].tolist()
            for a, b in zip([lo, *cuts], [*cuts, hi]):
                if b - a < min_match:
                    continue
                d = int(r.of[a])
                stats = automaton.statistics(code[a:b].tolist())
                for i, (length, s) in enumerate(stats):
                    if length >= min_match and (i + 1 == len(stats) or stats[i + 1][0] <= length):
                        for number, e in automaton.ends[s]:
                            matches.setdefault((d, number), []).append((int(a - bounds[d]) + i + 1 - length, e - length, length))
        spans: dict[int, list] = {}
        score = np.zeros(n)
        for (d, number), m in sorted(matches.items()):
            taken: list[tuple[int, int]] = []
            for lo, hi, covered in chains(m, max_gap):
                share = min(1.0, covered / sizes[number])
                if taken and (share < min_cover or any(lo < b and a < hi for a, b in taken)):
                    continue
                taken.append((lo, hi))
                score[d] = max(score[d], share)
                spans.setdefault(d, []).append({"label": names[number], "first": lo, "last": hi - 1, "covered": covered, "share": share})
        for d, list_ in spans.items():
            found[d] = {s["label"] for s in list_ if s["share"] >= min_cover}
        none = n_base == 0
        labels = [",".join(sorted(base.get(i, set()) | found[i])) for i in range(n)]
        return {
            "doc_id": rows.column(0), "n_words": r.per_document(), "n_base": n_base, "first_word": pa.array(first, mask=none),
            "last_word": pa.array(last, mask=none), "base_labels": [",".join(sorted(base.get(i, ()))) for i in range(n)],
            "labels": labels, "score": score, "spans": pa.array([spans.get(i, []) for i in range(n)], _spans_type()),
        }

    slim = only(docs, doc_id=doc_id, text=text)
    return map_runs(slim, "text", run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {SCANNED}", make)


def _spans_type():
    fields = [("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]
    return pa.list_(pa.struct(fields))
