"""Helpers of the tests in this folder."""

import random

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, tie long, shard int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and names that clash with inner ones."""
    base = prose(1, 300)
    words = base.split()
    edited = " ".join([*words[:150], "changed", *words[151:]])
    lines = "\n".join(prose(50 + i, 12) for i in range(6))
    rows = [
        (1, base, "en"), (2, base, "en"), (3, edited, None), (4, None, "en"), (5, "", None), (6, " \n\t ", "xx"), (7, "one two", "en"),
        (8, "one two", "de"), (9, lines, "en"), (10, prose(9, 8) + "\n" + lines + "\nmore", "en"), (11, lines, "en"), (11, lines, "en"),
        (None, base, None), (None, None, None), (12, prose(3, 40_000), "en"), (13, "spam " * 500, "en"), (14, "x", "not a code"),
        (15, "éè   日本語 \U0001f600 " * 9, "fr"), (16, base[: len(base) // 2] + " " + prose(4, 150), "en"),
    ]
    return [(i, t, lang, None if i == 3 else "s", None if t is None else len(t), 7, 8, 9) for i, t, lang in rows]


def rows_by_id(spark, folder: str) -> list[tuple]:
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
