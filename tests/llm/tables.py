"""Small tables for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("the of and a in".split()) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def prose(seed, n):
    return " ".join(words(random.Random(seed), n))


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, spaces only."""
    long = prose(1, 30_000)
    return [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n", "en", None, 3), (4, "One", "en", "b", None), (None, "nameless text here", "en", "b", 5),
        (5, long, "en", "a", len(long)), (6, long, "de", "b", len(long)), (7, prose(2, 60), "en", "a", 9), (7, prose(2, 60), "en", "a", 9), (8, prose(2, 60), None, None, None), (9, "ÀÉ ß 日本 🙂 " * 30, "xx", "c", 4),
    ]


def odd(spark, rows=None):
    """``odd_rows`` with columns whose names the operators use themselves."""
    extra = [(*r, 1, "x", 2.0, "p", 7, "h", "s", 9) for r in (odd_rows() if rows is None else rows)]
    return spark.createDataFrame(extra, DOCS + ", fp long, rule string, score double, spans string, size long, host string, shard string, slot long")


def table(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)
