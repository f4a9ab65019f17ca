"""A bounded sample of labelled documents, for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % by


def drawn(rows: DataFrame, place: Column, most: int) -> DataFrame:
    """At most ``most`` of ``rows``, the first by ``place`` (a 64-bit hash), the same in every run.

    What can't be among them is dropped by a bound on the place before anything is put in order, so that the sort's
    one task gets about twice as many rows, whatever the input.
    """
    share = (1.5 * most + 100) / max(1, rows.count())
    near = rows if share >= 1 else rows.where(F.shiftrightunsigned(place, 1) < int(share * 2**63))
    return near.orderBy(place, *rows.columns).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, rows: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``rows`` documents, the same in every run.

    An id with several label rows counts as 1 if any of them does; null labels and null ids are left out.
    Of an id's several texts the smallest stands for all. The ids drawn are at most ``rows``, so they can be
    broadcast to the scan of the documents, which is read once and not shuffled.
    """
    known = labels.select(F.col("doc_id"), F.col(target).cast("int").alias("label")).dropna().where(usable).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = drawn(known, F.xxhash64("doc_id"), rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
