"""Cleaning of messy cells. Missing values are NULL; ``present`` writes them as "Unknown" where they are shown or filtered."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import written
from . import columns

UNKNOWN = "Unknown"
#: Texts that stand for a missing one.
NULL_TOKENS = ("", "nan", "none", "null", "na", "n/a")
#: Spellings of the four relevance answers.
RELEVANCE = {"Yes": ("yes", "y", "true", "1"), "No": ("no", "n", "false", "0"), "Indirect": ("indirect", "indirectly", "partial", "partially")}
#: Parts of a text that tell the affiliation, tried in this order; ``=`` asks for the whole text.
AFFILIATION = {
    "Original Equipment Manufacturer": ("original equipment manufacturer", "=oem", "automaker", "vehicle manufacturer"),
    "Automotive supply chain participant": ("automotive supply chain participant", "supplier", "supply chain", "participant"),
}
NUMERIC = ("employment", "latitude", "longitude")
ROW_ID = "_row_id"


def column_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def normalised_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def text(c: Column) -> Column:
    flat = F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))
    return F.when(~F.lower(flat).isin(*NULL_TOKENS), flat)


def number(c: Column) -> Column:
    """The first number of a text, thousands separators aside."""
    return F.regexp_extract(F.replace(text(c), F.lit(","), F.lit("")), "-?[0-9]+([.][0-9]+)?", 0).try_cast("double")


def relevance(c: Column) -> Column:
    low = F.lower(text(c))
    return reduce(lambda when, kv: when.when(low.isin(*kv[1]), kv[0]), RELEVANCE.items(), F.when(F.lit(False), "")).otherwise(UNKNOWN)


def affiliation(c: Column) -> Column:
    low = F.lower(text(c))
    test = lambda part: low == part[1:] if part[0] == "=" else F.contains(low, F.lit(part))
    any_ = lambda parts: reduce(lambda a, b: a | b, map(test, parts))
    return reduce(lambda when, kv: when.when(any_(kv[1]), kv[0]), AFFILIATION.items(), F.when(F.lit(False), "")).otherwise(UNKNOWN)


def multi_value(c: Column) -> Column:
    """``a / b, c`` as ``a; b; c``."""
    parts = F.transform(F.split(text(c), r"[/,|&;]"), lambda p: F.trim(p))
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "; ")
    return F.when(joined != "", joined)


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit(UNKNOWN))


RULES = {
    **dict.fromkeys(NUMERIC, number),
    "ev_battery_relevant": relevance,
    "supplier_or_affiliation_type": affiliation,
    "primary_oems": multi_value,
}


def normalise(raw: DataFrame, required: str = "company", order: str | None = None) -> DataFrame:
    """The knowledge table: clean names and cells, rows without ``required`` dropped, ``_row_id`` dense in source order.

    ``order`` names the column of the source's own row numbers. Row numbers run over the whole table, so the sort is
    one range shuffle and the offsets of the partitions are added, rather than one task for all rows.
    """
    order = column_name(order) if order else None
    df = raw.toDF(*map(column_name, raw.columns)).na.drop(subset=[required])
    df = df if order else df.withColumn("source_row", F.monotonically_increasing_id())
    return dense_ids(df.select([RULES.get(c, text)(F.col(c)).alias(c) if c != order and dict(df.dtypes)[c] == "string" else F.col(c) for c in df.columns]), order or "source_row").drop(*([] if order else ["source_row"]))


def dense_ids(df: DataFrame, order: str, name: str = ROW_ID) -> DataFrame:
    """``name``: the row's place by ``order``, from 0, without gaps; rows that tie are in any order. An existing column of that name is replaced.

    The table is cut into ranges and written with the range of each row, and all that follows reads what was written: ranges, and ids made by
    the source's plan, differ from one run of a plan to the next. A random part of the order splits rows that tie, so no value fills a range.
    """
    placed = df.select(columns.row(df, name).alias("row"), columns.column(order).alias("place"), F.rand(7).alias("tie"))
    ranged = written.materialize(placed.repartitionByRange("place", "tie").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("place", "tie")) - 1
    return ranged.withColumn("within", within).join(F.broadcast(starts), "part").select("row.*", (F.col("start") + F.col("within")).alias(name))
