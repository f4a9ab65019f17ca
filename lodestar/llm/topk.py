"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length, longest first, and packed into blocks of like length. The block of the longest vectors gives every query
a first bound: its k-th best score there. The bound over the query's own length is the length that a candidate must have at least, and
queries are packed into blocks by it, so that a block of candidates shorter than all of a query block asks for never meets it: pairs of
blocks are chosen from their names and lengths alone, before any vector moves. Then each candidate block is shuffled once, and
the query blocks (a quarter of the size) are copied to those they meet. Within a pair the bound over both lengths is the cosine that a
candidate must reach (the block's local threshold). Above 1 the block is left out for that query;
from ``COORDINATE`` up, candidates are pruned by their normalised coordinates where the query's own are largest (each must lie
in the interval that the cosine leaves); below, candidates that are too short are cut off. What is left is verified by its exact product.

Components are floor(scale * x), held to the range of a long. Products are exact: in doubles while they stay under 2^53, else in Python integers.
Defined results: vectors that are null, empty, or hold a null or non-finite component, and null ids, take no part; every other row is a candidate
for all but itself, and rows with equal ids are rows of their own, as candidates and as queries; vectors of another dimension than the query's are no candidates; ties go to the smaller id; a
query with fewer candidates than k gets all; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

COORDINATE, FOCUS = 0.4, 3
BLOCK, QUERY_BLOCK = 4_096, 1_024
#: Buckets to a doubling of the length.
STEPS = 8


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``row, vec_id, v, dim, length, bucket``: a number for the row, the whole components as doubles, and the bucket of the length.

    To be written before use: the row's number is that of the plan's run.
    """
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = table.where(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & fine).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))
    v = v.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return v.select("row", "vec_id", "v", F.size("v").alias("dim"), "length", _bucket(F.col("length")).alias("bucket"))


def _bucket(length: Column) -> Column:
    return F.floor(F.log2(F.greatest(length, F.lit(1.0))) * STEPS).cast("int")


def _packed(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each block: its rows, ids, vectors end to end, bounds, greatest length and least length asked for."""
    for name in ("bound", "need"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("double"))
    all_ = rows.groupBy(*by).agg(F.collect_list(F.struct("row", "vec_id", "v", "bound")).alias("rows"), F.max("length").alias("longest"), F.min(F.coalesce("need", F.lit(0.0))).alias("need"))
    part = lambda name: F.transform("rows", lambda r: r[name])
    bounds = F.transform("rows", lambda r: F.coalesce(r["bound"], F.lit(float("-inf"))))
    return all_.select(*by, part("row").alias("places"), part("vec_id").alias("ids"), F.flatten(part("v")).alias("flat"), bounds.alias("bounds"), "longest", "need")


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    if p.size and np.abs(p).max() * np.abs(q).max() * p.shape[1] >= 2.0**53:
        exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in q] for x in p]
        return np.array([[min(max(s, 1 - 2**63), 2**63 - 1) for s in row] for row in exact], dtype=np.int64).reshape(len(p), len(q))
    return p @ q.T


def search(p: np.ndarray, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, q_rows: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query of a block: the rows, ids and scores of its k best among the vectors of another block, but for its own row."""
    lengths = np.sqrt((p * p).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    p, rows, ids, lengths = p[order], rows[order], ids[order], lengths[order]
    unit = p / np.maximum(lengths, 1e-12)[:, None]
    own = np.sqrt((q * q).sum(axis=1))
    short = []
    out = []

    def keep(j: int, places: np.ndarray, scores: np.ndarray) -> None:
        fine = (rows[places] != q_rows[j]) & (scores >= bounds[j])
        places, scores = places[fine], scores[fine]
        if len(places) > 4 * k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            places, scores = places[scores >= floor], scores[scores >= floor]
        best = _top(ids[places], scores, k)
        if len(best):
            out.append((j, rows[places[best]], ids[places[best]], scores[best]))

    for j in range(len(q)):
        scale = own[j] * lengths[0]
        cosine = bounds[j] / scale if scale > 0 and bounds[j] > 0 else -np.inf
        if cosine > 1 + 1e-9:
            continue
        if cosine < COORDINATE:
            short.append(j)
            continue
        cosine = min(cosine, 1.0)
        mine = q[j] / own[j]
        left = np.arange(int(np.searchsorted(-lengths, -bounds[j] / own[j] * (1 - 1e-9), side="right")))
        for c in np.argsort(-np.abs(mine), kind="stable")[:FOCUS]:
            half = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - mine[c] * mine[c])))
            x = unit[left, c]
            # The angle to the axis differs from the query's own by that cosine's angle at most.
            low = -1.0 if -mine[c] >= cosine else mine[c] * cosine - half
            top = 1.0 if mine[c] >= cosine else mine[c] * cosine + half
            left = left[(x >= low - 1e-9) & (x <= top + 1e-9)]
        keep(j, left, _products(p[left], q[j : j + 1])[:, 0])
    if short:
        least = min((bounds[j] / own[j] if own[j] > 0 and bounds[j] > 0 else -np.inf) for j in short)
        n = int(np.searchsorted(-lengths, -least * (1 - 1e-9), side="right")) if np.isfinite(least) else len(p)
        scores = _products(p[:n], q[short])
        for at, j in enumerate(short):
            keep(j, np.arange(n), scores[:, at])
    return out


def _blocks(pairs: DataFrame, k: int) -> DataFrame:
    """``query, query_id, row, vec_id, score``: the best of each query of ``pairs`` of blocks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                p, q = np.asarray(r.flat, float).reshape(-1, r.dim), np.asarray(r.q_flat, float).reshape(-1, r.dim)
                q_rows, q_ids = np.asarray(r.q_places, np.int64), np.asarray(r.q_ids, np.int64)
                found = search(p, np.asarray(r.places, np.int64), np.asarray(r.ids, np.int64), q, q_rows, np.asarray(r.q_bounds, float), k)
                if found:
                    yield pd.DataFrame({
                        "query": np.concatenate([np.full(len(i), q_rows[j]) for j, _, i, _ in found]),
                        "query_id": np.concatenate([np.full(len(i), q_ids[j]) for j, _, i, _ in found]),
                        "row": np.concatenate([r for _, r, _, _ in found]),
                        "vec_id": np.concatenate([i for _, _, i, _ in found]),
                        "score": [int(s) for _, _, _, scores in found for s in scores],
                    })

    columns = ("dim", "places", "ids", "flat", "q_places", "q_ids", "q_flat", "q_bounds")
    return pairs.select(*columns).mapInPandas(run, "query long, query_id long, row long, vec_id long, score long")


def _salted(rows: DataFrame, by: list[str], size: int, salt: str) -> DataFrame:
    """``rows`` with a ``salt`` that splits each group into parts of about ``size`` rows; the driver sees one count for each bucket of lengths."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("salts"))
    known = rows.sparkSession.createDataFrame([tuple(r) for r in sizes.collect()], sizes.schema)
    return rows.join(F.broadcast(known), by).withColumn(salt, F.pmod(F.xxhash64("row"), "salts")).drop("salts")


def top_k(table: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of each query; every other row is a candidate.

    ``is_query`` is over ``vec_id``. Of the rows the driver sees the number in each bucket of lengths only.
    """
    rows = materialize(vectors(table), "vectors")
    block, q_block = ["dim", "bucket", "salt"], ["dim", "q_bucket", "q_salt"]
    longest = rows.groupBy("dim").agg(F.max("bucket").alias("last"))
    packed = materialize(_packed(_salted(rows, block[:2], BLOCK, "salt"), *block), "blocks").drop("bounds", "need")
    packed = packed.join(F.broadcast(longest), "dim").withColumn("first", (F.col("bucket") == F.col("last")) & (F.col("salt") == 0)).drop("last")
    named = lambda q: q.select(*q_block, *[F.col(c).alias(f"q_{c}") for c in ("places", "ids", "flat", "bounds", "need")])
    queries = rows.where(is_query).withColumn("q_bucket", F.lit(0))
    head = packed.where("first").drop(*block[1:], "longest").join(named(_packed(_salted(queries, q_block[:2], QUERY_BLOCK, "q_salt"), *q_block)), "dim")
    head = materialize(_blocks(head, k), "head")
    least = F.min("score").cast("double")
    bound = head.groupBy("query").agg((least * (1 - 1e-12 * F.signum(least))).alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(F.col("query").alias("row"), "bound")
    need = F.when((F.col("bound") > 0) & (F.col("length") > 0), F.col("bound") / F.col("length")).otherwise(0.0)
    bounded = queries.join(bound, "row", "left").withColumn("need", need).withColumn("q_bucket", _bucket(F.col("need")))
    asked = materialize(named(_packed(_salted(materialize(bounded, "bounded"), q_block[:2], QUERY_BLOCK, "q_salt"), *q_block)), "asked")
    rest = packed.where(~F.col("first"))
    met = rest.select(*block, "longest").join(asked.select(*q_block, "q_need"), "dim").where(F.col("q_need") <= F.col("longest") * (1 + 1e-9)).select(*block, "q_bucket", "q_salt")
    pairs = met.join(asked, q_block).join(rest.drop("first", "longest"), block)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    return head.unionByName(_blocks(pairs, k)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
