"""Divergence of sources: how each source of a language uses the language's words, against every other source and against the whole.

Executors count words and documents by language, source and word, and add up what they have counted before it is shuffled. Words in enough
of a language's documents are kept. A group's share of a word is ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``, in integers throughout
(long division, three digits a step: exact while a language has fewer than 9e15 words).

Groups then meet in a systolic rotation. A language's words are dealt into slices of about ``WIDTH``, and its groups into blocks of ``ROOM`` or fewer. The vectors of a
block stay where they are, as partitions of one persisted table. In each round of a round-robin tournament (circle method) the compressed vectors of half of the
blocks move to their opponents, and a meeting gives the distances in both directions; the first round is each block with itself and with the language's own shares, where a heap for
each group keeps its ``TOP`` words by excess. Each round is one job, written when done. Distances are sums over slices, so a language of any number of words
and a source of any size is spread over tasks; what a task holds is one block's slice, ``ROOM`` times ``WIDTH`` numbers.

Defined results: null texts, languages and sources are empty strings; a group without words has a vector like any other; rows with equal ids are documents
of their own; without kept words all distances are 0 and no words are ranked; no rows give no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAST, SMOOTH, SCALE, TOP = 30, 5, 10**9, 50
WIDTH, ROOM = 1 << 14, 8
#: Counts that a task holds before it hands them on.
HELD = 400_000
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``lang, source, term, n, docs``; the empty term stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pd.DataFrame]:
        for (lang, source), (n, docs) in groups.items():
            terms = [b"", *n]
            yield pd.DataFrame({"lang": lang, "source": source, "term": [t.decode() for t in terms], "n": [0, *n.values()], "docs": [0, *(docs[t] for t in n)]})
        groups.clear()

    held = 0
    for part in parts:
        for lang, source, text in zip(part["lang"], part["source"], part["text"], strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            terms = TERM.findall(text.encode().lower())
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            if held > HELD:
                yield from handed()
                held = 0
    yield from handed()


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents by group and word, and a row of the empty word for each group; a written table."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text")).mapInPandas(_counts, "lang string, source string, term string, n long, docs long")
    return materialize(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "word-counts")


def share(count: Column, of: Column) -> Column:
    """``1 + floor(SCALE * (count + SMOOTH) / of)`` by long division."""
    rest, out = count + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, of), rest * 1000 % of
    return out + 1


def packed(index: np.ndarray, p: np.ndarray) -> bytes:
    """Ascending places, as differences, and the shares there."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(index, prepend=0).astype("<i4").tobytes() + p.astype("<i4").tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4").reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _packed_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        raw = [packed(np.array([x["place"] for x in xs], np.int64), np.array([x["p"] for x in xs], np.int64)) for xs in part["shares"]]
        yield part.drop(columns="shares").assign(vector=raw)


VECTORS = "lang string, slice int, block int, source string, own boolean, least long, width int, vector binary"


def kept(counts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, term, slice, place, n`` of the kept words, and ``lang, words, total, slices`` of each language; written tables."""
    words = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    words = materialize(words, "kept-words")
    langs = counts.select("lang").distinct().join(words.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("total")), "lang", "left").na.fill(0)
    langs = materialize(langs.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("words") / WIDTH)).cast("int")), "languages")
    words = words.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices").cast("int"))
    place = (F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).alias("place")
    return materialize(words.select("lang", "term", "slice", place, "n"), "placed-words"), langs


def vectors(counts: DataFrame, words: DataFrame, langs: DataFrame, room: int = ROOM) -> tuple[DataFrame, int]:
    """The compressed vectors of all groups by language, slice and block, with the language's own in each block; and the number of blocks."""
    own = counts.select("lang", "source", "term", "n").join(words.select("lang", "term", "slice", "place"), ["lang", "term"])
    own = materialize(own.drop("term"), "kept-counts")
    groups = counts.where("term = ''").select("lang", "source").join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"])
    groups = groups.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = materialize(groups, "groups")
    most = groups.agg(F.max("nth")).first()[0]
    blocks = max(2, -(-((most or 0) + 1) // room))
    blocks += blocks % 2
    widths = words.groupBy("lang", "slice").agg(F.count(F.lit(1)).cast("int").alias("width"))
    langs = langs.withColumnRenamed("total", "whole")
    groups = groups.join(langs, "lang").select("lang", "source", (F.col("total") + SMOOTH * F.col("words")).alias("of"), (F.col("nth") % blocks).cast("int").alias("block"), "slices")
    collected = lambda rows, by: rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "p"))).alias("shares"))
    shares = own.join(groups.select("lang", "source", "of"), ["lang", "source"]).select("lang", "source", "slice", "place", share(F.col("n"), F.col("of")).alias("p"))
    sliced = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).join(collected(shares, ("lang", "source", "slice")), ["lang", "source", "slice"], "left")
    zero = F.when(F.col("of") > 0, share(F.lit(0).cast("long"), F.col("of"))).otherwise(0)
    sliced = sliced.select("lang", "slice", "block", "source", F.lit(False).alias("own"), zero.alias("least"), F.coalesce("shares", F.array().cast("array<struct<place:int,p:bigint>>")).alias("shares"))
    whole = words.join(langs, "lang").select("lang", "slice", "place", share(F.col("n"), F.col("whole") + SMOOTH * F.col("words")).alias("p"))
    whole = collected(whole, ("lang", "slice")).select("lang", "slice", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("string").alias("source"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("least"), "shares")
    rows = sliced.unionByName(whole).join(widths, ["lang", "slice"], "left").na.fill(0, ["width"])
    return materialize(rows.select("lang", "slice", "block", "source", "own", "least", "width", "shares").mapInPandas(_packed_rows, VECTORS), "vectors"), blocks


def _dense(rows: pd.DataFrame) -> np.ndarray:
    out = np.empty((len(rows), int(rows["width"].iloc[0]) if len(rows) else 0), np.int64)
    for n, (least, raw) in enumerate(zip(rows["least"], rows["vector"], strict=True)):
        place, p = unpacked(raw)
        out[n] = least
        out[n, place] = p
    return out


MET = "lang string, source string, item string, value long"
LEADING = "lang string, source string, slice int, place int, value long"


Met = list[tuple[str, str, str, int]]


def _meet(lang: str, a: pd.DataFrame, b: pd.DataFrame) -> Met:
    """The distances of the groups of ``a`` and ``b``, in both directions; each vector of ``b`` is unpacked when it is met."""
    home, names, out = _dense(a), a["source"].tolist(), []
    for n, guest in enumerate(b["source"].tolist() if len(a) else ()):
        for name, value in zip(names, np.abs(home - _dense(b.iloc[n : n + 1])).sum(axis=1).tolist(), strict=True):
            out += [(lang, name, guest, value), (lang, guest, name, value)]
    return out


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")], dtype=object)


def _away(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """A block's distances from the one that visits it."""
    return _frame(_meet(key[0], a, b), MET)


def _at_home(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A block's distances within itself."""
    rows = rows[~rows["own"]].sort_values("source", ignore_index=True)
    return _frame([x for n in range(len(rows) - 1) for x in _meet(key[0], rows.iloc[n : n + 1], rows.iloc[n + 1 :])], MET)


def _leading(top: int):
    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The words of a slice in which each group of a block exceeds its language most."""
        out = []
        for whole in (_dense(rows[rows["own"]])[0:1] if rows["own"].any() else ()):
            for source, raw in rows.loc[~rows["own"], ["source", "vector"]].itertuples(index=False):
                place, p = unpacked(raw)
                more = p - whole[place]
                at = np.flatnonzero(more > 0)
                out += [(key[0], source, key[1], i, -v) for v, i in heapq.nsmallest(top, zip((-more[at]).tolist(), place[at].tolist(), strict=True))]
        return _frame(out, LEADING)

    return of


def rounds(blocks: int) -> list[list[tuple[int, int]]]:
    """The pairs of each round of a tournament in which all blocks (an even number) meet once."""
    last = blocks - 1
    return [[(last, r), *(((r + k) % last, (r - k) % last) for k in range(1, blocks // 2))] for r in range(last)]


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, room: int = ROOM) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has each other source of the language by distance, part ``term`` the ``top`` words by excess."""
    counts = counted(docs)
    words, langs = kept(counts, least)
    rows, blocks = vectors(counts, words, langs, room)
    key = ["lang", "slice", "block"]
    home = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).persist(StorageLevel.MEMORY_AND_DISK)
    met = [materialize(home.groupBy(*key).applyInPandas(_at_home, MET), "met")]
    leading = materialize(home.groupBy(*key).applyInPandas(_leading(top), LEADING), "leading")
    groups = home.where("not own")
    for pairs in rounds(blocks):
        to = dict(pairs)
        visit = F.element_at(F.array(*(F.lit(to.get(b)).cast("int") for b in range(blocks))), F.col("block") + 1)
        guests = rows.where("not own").withColumn("block", visit).where("block is not null")
        met.append(materialize(groups.groupBy(*key).cogroup(guests.groupBy(*key)).applyInPandas(_away, MET), "met"))
    home.unpersist()
    all_ = met[0]
    for more in met[1:]:
        all_ = all_.unionByName(more)
    pair = all_.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    term = leading.join(words.select("lang", "slice", "place", F.col("term").alias("item")), ["lang", "slice", "place"]).select("lang", "source", "item", "value", F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")).alias("rank")
    ranked = pair.unionByName(term).select("lang", "source", "part", "item", "value", rank)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
