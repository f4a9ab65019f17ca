"""Tokens, phrases and patterns of texts. Classes are ASCII, so that other engines agree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def words(pattern: str, c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r]+", " "))


def tokens(c: Column) -> Column:
    return words("[a-z0-9]+(?:/[a-z0-9]+)?", flat(c))


def singular(t: Column) -> Column:
    return F.when(t.endswith("ies") & (F.length(t) > 4), F.regexp_replace(t, "ies$", "y")).when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3), F.regexp_replace(t, "s$", "")).otherwise(t)


def token_set(c: Column) -> Column:
    """Tokens and their singulars."""
    return F.array_union(tokens(c), F.transform(tokens(c), singular))


def slash_flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[ \\t\\n/]+", " "))


def tiers(c: Column) -> Column:
    """Tier numbers that a question asks for, sorted: ``tier 1/2``, ``tier 1 and 2``, ``tier 3``."""
    q = flat(c)
    joined = r"\btier\s*([0-9]+)\s*(?:/|and|or|&|,)\s*(?:tier\s*)?([0-9]+)\b"
    found = [F.regexp_extract_all(q, F.lit(joined), F.lit(g)) for g in (1, 2)]
    return F.array_sort(F.array_distinct(F.concat(*found, F.regexp_extract_all(q, F.lit(r"\btier\s*([0-9]+)\b"), F.lit(1)))))


def slash_phrases(c: Column) -> Column:
    return F.array_distinct(words(r"(?:[a-z]+\s+)?[0-9]+/[0-9]+|[a-z]+/[a-z]+", F.lower(c)))


def holds_word(c: Column, word: str) -> Column:
    return F.regexp_like(F.lower(c), F.lit(rf"\b{word}\b"))


def ngrams(found: Column, longest: int, least: int = 1) -> Column:
    """All runs of 1 to ``longest`` tokens, shorter runs first, space-joined, of ``least`` letters or more.

    The tokens are found once a text: a lambda's body would find them anew for each run.
    """
    def runs(own: Column, n: int) -> Column:
        starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " "))

    def all_(own: Column) -> Column:
        return F.filter(F.flatten(F.array(*[runs(own, n) for n in range(1, longest + 1)])), lambda p: F.length(p) >= least)

    return once(found, all_)


def phrases(cell: Column, longest: int = 3, least: int = 4) -> Column:
    """The phrases of a cell: its n-grams, and the whole cell if it isn't among them."""
    whole = F.trim(F.lower(cell))
    runs = ngrams(words("[a-z][a-z0-9-]*", F.lower(cell)), longest, least)
    return F.concat(runs, F.when((F.length(whole) >= least) & ~F.array_contains(runs, whole), F.array(whole)).otherwise(F.array().cast("array<string>")))


def question_ngrams(q: Column, longest: int = 6) -> Column:
    return ngrams(words("[A-Za-z0-9]+(?:/[A-Za-z0-9]+)*", q), longest, 3)


def component(c: Column, word: str = "county") -> Column:
    """The first comma-part of a place that holds ``word``, else all of it."""
    parts = F.filter(F.split(c, ","), lambda p: F.contains(F.lower(p), F.lit(word)))
    return F.coalesce(F.trim(F.get(parts, F.lit(0))), F.trim(c), F.lit("Unknown"))


def answer_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda w: F.length(w) >= 3))


#: Every byte that no word holds is a space; of letters beyond ASCII all bytes are.
SPACED = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256))


def long_answer_words(c: Column) -> Column:
    """The words of ``answer_words`` in any order, by Python's bytes, as splitting by an expression takes most of the time on long texts."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        parts = []
        for n in range(0, max(1, len(texts)), 500):  # only as many texts' words are Python objects at once
            part, words, ends = texts.slice(n, 500), [], [0]
            for t in part.cast(pa.binary()).to_pylist():
                words += () if t is None else [w for w in dict.fromkeys(t.translate(SPACED).split()) if len(w) >= 3]
                ends.append(len(words))
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.binary()).cast(pa.string()), mask=part.is_null()))
        return pa.concat_arrays(parts)

    # Else a filter for empty lists, which explode() brings, would find the words a second time.
    return found.asNondeterministic()(F.lower(c))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_f1(a: Column, b: Column) -> Column:
    """Of two arrays of different words: twice the shared over the sum of sizes; 0 if either is empty."""
    def f1(s: Column) -> Column:
        both = F.size(s["x"]) + F.size(s["y"])
        return F.when((F.size(s["x"]) > 0) & (F.size(s["y"]) > 0), 2.0 * F.size(F.array_intersect(s["x"], s["y"])) / both).otherwise(F.lit(0.0))

    return once(F.struct(a.alias("x"), b.alias("y")), f1)


def token_f1(a: Column, b: Column) -> Column:
    """``words_f1`` of the words of two texts."""
    return words_f1(answer_words(a), answer_words(b))


#: Answer words that never need support.
ANSWER_STOP_WORDS = (
    "about", "above", "according", "answer", "based", "because", "below", "company", "companies", "complete", "contains", "county", "data", "does", "each", "evidence",
    "following", "from", "georgia", "include", "includes", "item", "items", "listed", "provided", "record", "records", "result", "results", "shows", "supplier",
    "suppliers", "table", "there", "these", "this", "total", "using", "with", "would",
)


def risk(answer: Column, evidence: Column) -> Column:
    """Low, Medium or High by the share of an answer's words that the evidence lacks."""
    mark = r"[.,;?!\"'()\[\]{}:]+"
    bare = F.lower(F.regexp_replace(answer, rf"(?:^|(?<=[ \t\n\r])){mark}|{mark}(?=[ \t\n\r]|$)", ""))
    mine = F.filter(F.split(bare, "[ \\t\\n\\r]+"), lambda w: (F.length(w) > 4) & ~w.isin(*ANSWER_STOP_WORDS) & (F.translate(w, "0123456789", "") != ""))

    def level(s: Column) -> Column:
        ratio = F.size(F.filter(s["words"], lambda w: ~F.contains(s["low"], w))) / F.greatest(F.size(s["words"]), F.lit(1))
        return once(ratio, lambda r: F.when(r < 0.20, "Low").when(r < 0.45, "Medium").otherwise("High"))

    found = once(F.struct(mine.alias("words"), F.lower(evidence).alias("low")), level)
    return F.when(F.coalesce(evidence, F.lit("")) == "", "High").otherwise(found)


def clean_answer(c: Column) -> Column:
    """An answer without hidden thoughts and code fences."""
    bare = F.regexp_replace(F.regexp_replace(c, "(?is)<think>.*?</think>", ""), "(?m)^```[a-z]*\\s*$", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def prefixed(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(F.lower(c), F.lit(prefix.lower())), c).otherwise(F.concat(F.lit(prefix), c))


def json_object(c: Column) -> Column:
    """The outermost braces of a text as JSON, NULL if that isn't an object."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.json_object_keys(inner).isNotNull(), inner)


def holds_keys(c: Column, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.lit(keys), F.json_object_keys(json_object(c)))) == 0, F.lit(False))
