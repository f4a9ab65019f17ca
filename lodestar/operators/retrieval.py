"""Search: vectors, BM25, column overlap, and their fusion by reciprocal rank. Many queries are one job: each row carries its query."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import text
from ..sources.written import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_search(corpus: DataFrame, query: list[float], key: str, embedding: str = "embedding", k: int = 15, threshold: float = 0.0) -> DataFrame:
    """The ``k`` rows nearest to one query: a scan, and the best of each partition."""
    q = F.lit([float(x) for x in query])
    return corpus.withColumn("score", cosine(F.col(embedding), q)).where(F.col("score") >= threshold).orderBy(F.col("score").desc(), key).limit(k)


def chunk_search(chunks: DataFrame, query: list[float], parent: str, key: str, embedding: str = "embedding", k: int = 15, threshold: float = 0.0) -> DataFrame:
    """``parent, score`` of the ``k`` parents with the nearest chunks, among the 4k nearest chunks."""
    near = vector_search(chunks, query, key, embedding, 4 * k, threshold)
    return near.groupBy(parent).agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), parent).limit(k)


@F.pandas_udf(ArrayType(FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    """The offline embedder: words hashed to 256 signed places, then to length 1. The same text always gives the same vector."""
    import re
    import zlib

    out = np.zeros((len(texts), 256), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            out[i, h % 256] += 1 if h >> 16 & 1 else -1
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return pd.Series(list(out))


def tokens(body: Column) -> Column:
    """The words between ASCII white space, lower-cased."""
    trimmed = F.trim(F.lower(body), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed != "", F.split(trimmed, r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>"))


def postings(docs: DataFrame, key: str, body: Column) -> DataFrame:
    """``key, length, term, tf``: an index to keep where many queries follow."""
    each = docs.select(key, tokens(body).alias("words")).select(key, F.size("words").alias("length"), F.explode("words").alias("term"))
    return each.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class Kept:
    """A written index for many BM25 queries: postings in order of their terms, and three figures of the whole table."""

    held: DataFrame
    n: int
    mean_length: float
    floor: float


def keep(docs: DataFrame, key: str, body: Column, epsilon: float = 0.25) -> Kept:
    """Postings are spread by term and key, so a frequent term is in many files, and a rare one is read from few."""
    whole = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(body))).alias("mean")).first()
    held = materialize(postings(docs, key, body).repartitionByRange("term", key).sortWithinPartitions("term", key), "postings")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    floor = df.agg(F.avg(F.log(whole["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)) * epsilon).first()[0]
    return Kept(held, whole["n"], whole["mean"] or 1.0, floor or 0.0)


def best(scored: DataFrame, key: str, k: int) -> DataFrame:
    """``probe, key, rank`` of each probe's ``k`` best rows, ranks from 0."""
    order = Window.partitionBy("probe").orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("probe", key, (F.col("rank") - 1).alias("rank"))


def bm25_each(kept: Kept, key: str, probes: list[str], k: int = 50, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``probe, key, rank``: ``bm25`` for every probe in one job, which reads the postings of their terms alone."""
    counts = [(n, t, c) for n, p in enumerate(probes) for t, c in Counter(p.lower().split()).items()]
    asked = kept.held.sparkSession.createDataFrame(counts, "probe int, term string, times int")
    hits = kept.held.where(F.col("term").isin(*{t for _, t, _ in counts}))
    idf = F.log(kept.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighed = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.when(idf < 0, kept.floor).otherwise(idf))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / kept.mean_length))
    scored = hits.join(F.broadcast(weighed.join(F.broadcast(asked), "term")), "term").groupBy("probe", key).agg(F.sum(part).alias("score"))
    return best(scored.where("score > 0"), key, k)


def bm25_set(kept: Kept, key: str, asked: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``q, probe, key, rank`` for a table of probes ``asked(q, probe, term, times)`` of any size: one join with the postings, sums before the shuffle."""
    df = kept.held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(kept.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighed = asked.join(df, "term").withColumn("idf", F.when(idf < 0, kept.floor).otherwise(idf))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / kept.mean_length))
    scored = kept.held.join(weighed, "term").groupBy("q", "probe", key).agg(F.sum(part).alias("score"))
    return best_set(scored.where("score > 0"), key, k)


def overlap_set(held: DataFrame, key: str, asked: DataFrame, k: int = 50) -> DataFrame:
    """``q, probe, key, rank`` by shared words, of distinct words ``held(key, word)`` and ``asked(q, probe, word)``."""
    return best_set(held.join(asked, "word").groupBy("q", "probe", key).agg(F.count(F.lit(1)).alias("score")), key, k)


def best_set(scored: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("q", "probe").orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "probe", key, (F.col("rank") - 1).alias("rank"))


def bm25(docs: DataFrame, key: str, body: Column, query: str, k: int = 50, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25 of one query; a token asked twice counts twice; terms in most documents get a fraction of the mean weight.

    Document frequencies are summed before the shuffle; term frequencies are made for the asked terms alone.
    """
    asked: dict[str, int] = {}
    for t in query.lower().split():
        asked[t] = asked.get(t, 0) + 1
    rows = docs.select(key, tokens(body).alias("words"))
    corpus = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean_length"))
    df = rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = df.join(F.broadcast(corpus)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = weighed.agg((F.avg("idf") * epsilon).alias("floor"))
    times = F.element_at(F.create_map(*[F.lit(x) for pair in (asked or {"": 0}).items() for x in pair]), F.col("term"))
    used = weighed.where(F.col("term").isin(*asked)).withColumn("times", times).join(F.broadcast(floor)).withColumn("idf", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")))
    held = rows.select(key, F.size("words").alias("length"), F.explode(F.filter("words", lambda w: w.isin(*asked))).alias("term"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    counted = held.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    scored = counted.join(F.broadcast(used), "term").groupBy(key).agg(F.sum(part).alias("score")).where("score > 0")
    return scored.orderBy(F.col("score").desc(), key).limit(k)


#: Fixed value: the words that overlap counts.
WORD = "[a-z][a-z0-9-]*"


def words_asked(query: str) -> list[str]:
    return sorted(set(re.findall(WORD, query.lower()))) or [""]


def words_held(columns: list[str]) -> Column:
    return F.array_distinct(text.words(WORD, F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))))


def overlap(df: DataFrame, query: str, columns: list[str], key: str, k: int = 50) -> DataFrame:
    """``key, score``: the distinct words of the query that stand in the columns."""
    scored = df.withColumn("score", F.size(F.array_intersect(words_held(columns), F.lit(words_asked(query))))).where("score > 0")
    return scored.orderBy(F.col("score").desc(), key).limit(k).select(key, "score")


def overlap_each(df: DataFrame, probes: list[str], columns: list[str], key: str, k: int = 50) -> DataFrame:
    """``probe, key, rank``: ``overlap`` for every probe in one scan. Probes are few, and a row goes on for those alone that it shares a word with."""
    words = df.select(key, words_held(columns).alias("words"))
    shared = F.array(*[F.struct(F.lit(n).alias("probe"), F.size(F.array_intersect("words", F.lit(words_asked(p)))).alias("score")) for n, p in enumerate(probes)])
    return best(words.select(key, F.inline(F.filter(shared, lambda x: x["score"] > 0))), key, k)


def ranks(found: DataFrame, key: str, source: int) -> DataFrame:
    """One list for fusion: ``list, key, rank`` from 0. The list is a top-k, so its order is one small task."""
    return found.select(F.lit(source).alias("list"), key, (F.row_number().over(Window.orderBy(F.col("score").desc(), key)) - 1).alias("rank"))


def rrf(lists: list[DataFrame], key: str, constant: int = 60, k: int = 150) -> DataFrame:
    """Reciprocal rank fusion; ties in the order in which rows first appear."""
    all_ = reduce(DataFrame.unionByName, lists)
    fused = all_.groupBy(key).agg(F.sum(1.0 / (constant + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return fused.orderBy(F.round("score", 12).desc(), "first", key).limit(k).select(key, "score", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"))


def keep_first(lists: list[DataFrame], key: str) -> DataFrame:
    """Each row once, from the first list that has it."""
    order = Window.partitionBy(key).orderBy("list", "rank")
    return reduce(DataFrame.unionByName, lists).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
