"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells; every shard owns ``NODES`` virtual nodes on it, and a key belongs to the first node clockwise of
its cell. A shard takes at most its share of the rows (the rest of the division goes to the first shards, one row each);
keys that meet a full shard continue clockwise to the next node of one that isn't. So counts are at most one apart,
and a key moves only if its own shard, or those on its way, fill up otherwise.

The executors count rows by cell. That table of ``CELLS`` counts, whatever the input, is all the driver sees: it walks the ring
and cuts each cell into runs of ranks, each with a shard and its first slot. Ranks are made from narrow rows: equal rows are counted
first, the counts added up in the order of the rows' hashes within 1,024 ranges of a cell, and equal rows numbered in parts of ``PART``.
So neither a key nor a row that a third of the table repeats makes a task of its own size; the whole rows move once, by row number.

Defined results: a null text has size 1 and the checksum of the empty text; a null key has a place like any other; equal rows are
interchangeable; an empty table gives an empty result. Extra columns of any type are kept; names that clash with the added ones are replaced.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns
from .common import materialize

BITS = 14
CELLS = 1 << BITS
NODES = 128
#: Equal rows that one task numbers.
PART = 100_000


def owners(shards: int) -> tuple[list[int], list[int]]:
    """The nodes' shards in ring order, and for each cell the index of the first node clockwise."""
    at: dict[int, int] = {}
    for replica in range(NODES):
        for shard in range(shards):
            cell = xxhash.xxh64_intdigest(f"{shard}:{replica}", 7) >> (64 - BITS)
            while cell in at and len(at) < CELLS:
                cell = (cell + 1) % CELLS
            at[cell] = shard
    places = sorted(at)
    first, node = [], 0
    for cell in range(CELLS):
        while node < len(places) and places[node] < cell:
            node += 1
        first.append(node % len(places))
    return [at[p] for p in places], first


def runs(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """``(cell, from rank, to rank, shard, first slot)``, the ends exclusive."""
    ring, first = owners(shards)
    share, rest = divmod(sum(counts.values()), shards)
    room = [share + (s < rest) for s in range(shards)]
    slot, out = [0] * shards, []
    for cell in sorted(counts):
        node, done, left = first[cell], 0, counts[cell]
        while left:
            shard = ring[node]
            if n := min(left, room[shard]):
                out.append((cell, done, done + n, shard, slot[shard]))
                room[shard] -= n
                slot[shard] += n
                done, left = done + n, left - n
            node = (node + 1) % len(ring)
    return out


def _content(docs: DataFrame) -> Column:
    """A hash of the whole row; what can't be hashed is hashed as JSON."""
    plain = lambda f: not any(t in f.dataType.simpleString() for t in ("map<", "variant"))
    return F.xxhash64(*[columns.column(f.name) if plain(f) else F.to_json(F.struct(columns.column(f.name))) for f in docs.schema])


def _ranked(rows: DataFrame) -> DataFrame:
    """``row, cell, rank`` of ``rows(row, cell, content)``: a number from 0 in each cell, by content."""
    range_ = F.shiftright("content", 54)
    classes = materialize(rows.groupBy("cell", range_.alias("range"), "content").agg(F.count(F.lit(1)).alias("n")), "shard-classes")
    upto = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, by, order: F.coalesce(F.sum(n).over(upto(by, order)), F.lit(0))
    ranges = classes.groupBy("cell", "range").agg(F.sum("n").alias("rows"))
    ranges = ranges.select("cell", "range", before("rows", ["cell"], "range").alias("range_start"))
    classes = classes.withColumn("start", before("n", ["cell", "range"], "content")).join(ranges, ["cell", "range"])
    classes = classes.select("cell", "content", (F.col("start") + F.col("range_start")).alias("start"), "n")
    several = F.when(F.col("n") > 1, F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / PART))).otherwise(0)
    placed = materialize(rows.join(classes, ["cell", "content"]).withColumn("part", several), "shard-rows")
    same = placed.where("n > 1")
    key = ["cell", "content", "part"]
    parts = same.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.select(*key, before("rows", key[:2], "part").alias("part_start"))
    copies = same.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("row")) - 1).join(parts, key)
    alone = placed.where("n = 1").select("row", "cell", F.col("start").alias("rank"))
    return alone.unionByName(copies.select("row", "cell", (F.col("start") + F.col("part_start") + F.col("copy")).alias("rank")))


def sharded(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within the shard)."""
    docs = docs.drop("shard", "slot")
    cell = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), 64 - BITS).cast("int")
    whole = docs.select(columns.row(docs).alias("doc"), cell.alias("cell"), _content(docs).alias("content"), F.monotonically_increasing_id().alias("row"))
    whole = materialize(whole, "shard-docs")
    counts = {r["cell"]: r["count"] for r in whole.groupBy("cell").count().collect()}
    cuts = F.broadcast(docs.sparkSession.createDataFrame(runs(counts, shards), "cell int, run_from long, run_to long, shard int, run_slot long"))
    inside = (F.col("rank") >= F.col("run_from")) & (F.col("rank") < F.col("run_to"))
    placed = _ranked(whole.select("row", "cell", "content")).join(cuts, "cell").where(inside)
    placed = placed.select("row", "shard", (F.col("run_slot") + F.col("rank") - F.col("run_from")).alias("slot"))
    return whole.select("row", "doc").join(placed, "row").select("doc.*", "shard", "slot")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes and one) and ``text_crc32`` of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"))
