"""Mixing sources to target weights by capped water-filling.

The sources share the corpus's total size by weight. A target that would need more than ``epochs`` passes over its
source stops there, and what is left over is shared again among the others by weight, until none is above.
That end state is found at once: with sources in order of cap over weight, those before the first that isn't
capped are capped, and the rest get one common rate.

A source's documents are then taken whole as often as the target holds the source; for the rest, documents
are taken once more in a seeded order until the target is met, the last of them in part. So each source's words come to
its rounded target. The order is cut by a histogram of 4096 hash buckets a source, which is summed before the shuffle;
only the one bucket that holds the cut is put in order. What comes of it is a row for each source, and every
document is compared with its source's row alone.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order;
equal rows are taken alike, so that where several stand at the cut a source may miss its
target by fewer words than there are of them; if all sizes are 0 so are all targets; an empty table gives an
empty result. Extra columns are kept; ``sized`` replaces those whose names it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns
from .common import materialize

WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text: str = "text", seed: int = 42) -> DataFrame:
    """``docs`` with ``size`` in words and its seeded place in the order."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (
        docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long"))
        .withColumn("mix_order", order)
        .withColumn("mix_bucket", F.conv(F.substring("mix_order", 1, 3), 16, 10).cast("int"))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """``source, source_size, weight, target`` of each row of ``sizes(source, source_size)``."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    filled = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, used = F.coalesce(F.sum("cap").over(order), F.lit(0.0)), F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    rated = filled.withColumn("rate", (F.sum("source_size").over(everything) - before) / (F.sum("weight").over(everything) - used))
    free = F.when(F.col("cap") >= F.col("rate") * F.col("weight"), F.col("rate"))
    common = F.min_by(free, F.when(free.isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("rate")))).over(everything)
    target = F.least("cap", F.coalesce(common, F.lit(0.0)) * F.col("weight"))
    return rated.withColumn("target", target).select("source", "source_size", "weight", "target")


def plan(measured: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """For each source of ``measured`` (a written table): its target, the whole passes, and where in the order the last one stops.

    A written table with a row for each source: ``mix_source, source_size, target, passes, cut_order, cut_size, cut_part``. Rows before
    (cut_order, cut_size) are taken once more, rows at it give ``cut_part`` words each, rows after it none.
    """
    cells = materialize(measured.groupBy("source", "mix_bucket").agg(F.sum("size").alias("words")), "mix-cells")
    goal = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("passes") * F.col("source_size")))
    goal = materialize(goal.withColumnRenamed("source", "mix_source").drop("weight"), "mix-goals")
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    upto = Window.partitionBy("source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    hit = cells.join(goal, same).where("before < rest").groupBy("mix_source").agg(F.max_by(F.struct("mix_bucket", "before"), "mix_bucket").alias("cell"), F.max("rest").alias("rest"))
    hit = hit.select("mix_source", F.col("cell.mix_bucket").alias("cut_bucket"), (F.col("rest") - F.col("cell.before")).alias("left"))
    keyed = measured.groupBy("source", "mix_bucket", "mix_order", "size").agg(F.count(F.lit(1)).alias("n"))
    keyed = keyed.join(hit, same & (F.col("mix_bucket") == F.col("cut_bucket")))
    along = Window.partitionBy("mix_source").orderBy("mix_order", "size").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("done", F.sum(F.col("size") * F.col("n")).over(along) - F.col("size") * F.col("n"))
    at = keyed.where((F.col("done") < F.col("left")) & (F.col("done") + F.col("size") * F.col("n") >= F.col("left")))
    at = at.select(F.col("mix_source").alias("cut_source"), F.col("mix_order").alias("cut_order"), F.col("size").alias("cut_size"), F.floor((F.col("left") - F.col("done")) / F.col("n")).alias("cut_part"))
    out = goal.join(at, F.col("mix_source").eqNullSafe(F.col("cut_source")), "left").na.fill({"cut_order": "", "cut_size": -1, "cut_part": 0})
    return materialize(out.drop("cut_source", "rest", "cap", "rate"), "mix-plan")


def mixed(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """``measured`` (see ``sized``) with ``source_size``, ``target``, ``passes`` and ``part``, the words taken besides whole passes."""
    rows = measured.join(plan, F.col("source").eqNullSafe(F.col("mix_source")))
    key, cut = F.struct("mix_order", "size"), F.struct(F.col("cut_order").alias("mix_order"), F.col("cut_size").alias("size"))
    part = F.when(key < cut, F.col("size")).when(key == cut, F.col("cut_part")).otherwise(0).cast("long")
    return rows.withColumn("part", part).drop("mix_source", "cut_order", "cut_size", "cut_part", "mix_order", "mix_bucket")


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    return materialize(sized(docs.select("doc_id", "source", "text")).select(*more, "source", "size", "mix_order", "mix_bucket"), "mix-sizes")


def taken(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    measured = _measured(docs, "doc_id")
    out = mixed(measured, plan(measured))
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, the one at a source's cut with its first words only."""
    rows = sized(docs.select(columns.row(docs).alias("mix_row"), "doc_id", "source", "text"))
    out = mixed(rows, plan(_measured(docs)))
    whole = F.col("passes") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    out = out.select("mix_row", "text", "part", F.explode(F.concat(F.array_repeat(F.lit(True), whole.cast("int")), cut)).alias("whole"))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    out = out.select("mix_row", F.when(~F.col("whole"), first).alias("first"))
    own = lambda c: F.col("mix_row").getField(c)
    changed = {"text": F.coalesce("first", own("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("first").isNotNull(), F.length("first")).otherwise(own("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, own(c)).alias(c) for c in docs.columns))
