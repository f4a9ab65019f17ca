"""Discovery of the terms that candidate rows use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Weights of columns.
HIGH = ("product_service", "ev_supply_chain_role", "supplier_type", "primary_oems")
MEDIUM = ("notes",)
SKIPPED = ("_row_id", "latitude", "longitude", "address", "company", "location", "_score")


def weight(column: str) -> float:
    return 2.0 if column in HIGH else 1.0 if column in MEDIUM else 0.5


def discover(candidates: DataFrame, match: dict[str, str], row_id: str = "_row_id", least: int = 2, top: int = 30, weights: dict[str, float] | None = None) -> DataFrame:
    """``term, frequency, weight, columns, rows``: terms in order of weight times occurrences, with the first five rows of each.

    Exact columns give whole cells, others phrases. Each occurrence is a row of its own until the combined aggregate; the row ids kept for a
    term are five at most, by a ranked filter.
    """
    cells = []
    for c, kind in match.items():
        if c in SKIPPED or c not in candidates.columns or kind == "numeric":
            continue
        cell = F.col(c).cast("string")
        found = F.array(F.lower(F.trim(cell))) if kind == "exact" else text.phrases(cell)
        cells.append(F.struct(F.lit(c).alias("column"), F.lit((weights or {}).get(c, weight(c))).alias("weight"), F.filter(found, lambda p: F.length(p) >= (1 if kind == "exact" else 4)).alias("terms")))
    each = candidates.select(F.col(row_id).alias("row"), F.inline(F.array(*cells))).select("row", "column", "weight", F.explode("terms").alias("term"))
    by_row = each.groupBy("term", "row").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.collect_set("column").alias("columns"))
    stats = by_row.groupBy("term").agg(F.sum("n").alias("frequency"), F.max("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns")))).alias("columns"))
    best = stats.where(F.col("frequency") >= least).orderBy((F.col("weight") * F.col("frequency")).desc(), "term").limit(top)
    rank = F.row_number().over(Window.partitionBy("term").orderBy("row"))
    rows = by_row.join(F.broadcast(best.select("term")), "term", "left_semi").withColumn("rank", rank).where("rank <= 5").groupBy("term").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return best.join(rows, "term")
