"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits, each padded to a 23-bit word.
If two fingerprints differ in 3 bits or fewer, at most one segment holds two errors or more, so
two segments hold at most one error each (pigeonhole). For each pair of segments one side is
indexed under the codewords it decodes to, the other probes with all codewords near its own
segments; a join on (pair, codeword, codeword) meets every pair of fingerprints within 3 bits,
and the bit count of their difference verifies it.

Defined results: a null text, and one without words, has fingerprint zero and is linked like any other.
Repeated rows and equal texts share a fingerprint; only distinct fingerprints are joined.
A null doc_id is kept in its row and never becomes a component's id unless the component has no other.
An empty table gives an empty result. Extra columns are kept; names that clash with the added ones are
replaced. Joins are merges, so that nothing that grows with the documents is broadcast by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import connected_components, materialize

SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Shingles whose hashes are counted at once; bounds memory for very long texts.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """Of the words between ASCII white space, A-Z lower-cased, in shingles with repeats. Signed 64 bits."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total = len(starts)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(flat[s:e], 42) for s, e in spans], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the signed 64-bit fingerprint of each whole text."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([fingerprint(x, width) for x in part], dtype="int64")

    return docs.withColumn("fp", of(F.col(text)))


def _words(fps: np.ndarray) -> list[np.ndarray]:
    bits = fps.view(np.uint64)
    return [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _index_keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        fps = part["fp"].to_numpy(np.int64)
        codes = [golay.decode(w) for w in _words(fps)]
        keys = [(p << 24) | (codes[i] << 12) | codes[j] for p, (i, j) in enumerate(PAIRS)]
        yield pd.DataFrame({"key": np.concatenate(keys), "fp": np.tile(fps, len(PAIRS))})


def _probe_keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        fps = part["fp"].to_numpy(np.int64)
        near = [golay.near(w) for w in _words(fps)]
        for p, (i, j) in enumerate(PAIRS):
            keys = (p << 24) | (near[i][0][:, :, None] << 12) | near[j][0][:, None, :]
            row, a, b = np.nonzero(near[i][1][:, :, None] & near[j][1][:, None, :])
            yield pd.DataFrame({"key": keys[row, a, b], "probe": fps[row]})


def links(fps: DataFrame) -> DataFrame:
    """Every pair ``(a, b)`` of distinct values of ``fps.fp`` that differ in 3 bits or fewer, once."""
    index = fps.mapInPandas(_index_keys, "key long, fp long")
    probe = fps.mapInPandas(_probe_keys, "key long, probe long")
    near = (F.col("fp") < F.col("probe")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= 3)
    return index.join(probe.hint("merge"), (index["key"] == probe["key"]) & near).select(F.col("fp").alias("a"), F.col("probe").alias("b")).distinct()


def components(fps: DataFrame) -> DataFrame:
    """``fp, root, component_id`` of every distinct value of ``fps(doc_id, fp)``, as a written table.

    root is the component's smallest fingerprint, component_id its smallest doc_id.
    """
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    roots = materialize(connected_components(links(least.select("fp"))).select(F.col("node").alias("fp"), "root"), "roots")
    least_of_root = roots.join(least.hint("merge"), "fp").groupBy("root").agg(F.min("least").alias("least_of_root"))
    named = roots.join(least_of_root.hint("merge"), "root").select("fp", "root", "least_of_root")
    return materialize(
        least.join(named.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least_of_root", "least").alias("component_id")),
        "component",
    )


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; component_id is the smallest doc_id reachable over links."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = materialize(fingerprints(narrow, "text", width).select("doc_id", "fp"), "fps")
    return fps.join(components(fps).hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """``docs`` without near copies: one row of each component stays, that of the smallest doc_id (null last)."""
    clash = [c for c in docs.columns if c.lower() in ("fp", "simhash_row")]
    if clash:
        docs = docs.withColumnsRenamed({c: f"kept {c}" for c in clash})
    tagged = materialize(fingerprints(docs, text, width).withColumn("simhash_row", F.monotonically_increasing_id()), "tagged")
    fps = tagged.select(F.col(doc_id).alias("doc_id"), "fp", "simhash_row")
    first = F.min_by("simhash_row", F.struct(F.col("doc_id").isNull(), "doc_id", "simhash_row"))
    kept = fps.join(components(fps).hint("merge"), "fp").groupBy("root").agg(first.alias("simhash_row")).select("simhash_row")
    out = tagged.join(kept.hint("merge"), "simhash_row", "left_semi").drop("simhash_row", "fp")
    return out.withColumnsRenamed({f"kept {c}": c for c in clash})
