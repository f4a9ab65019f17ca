"""What several operators share: connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import drop, materialize

__all__ = ["connected_components", "drop", "materialize"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; root is the component's smallest node.

    Alternating large-star and small-star steps: the edge count never grows, and the number of
    rounds is logarithmic in practice. Each step takes one minimum per node, which is combined
    before the shuffle, and one equi-join of two written tables, which Spark splits where a node is hot.
    Joins are merges, however small a side is: the driver would hold both what it gathers and what it sends of a side to be broadcast, round after round.
    Edges from a node to itself only name the node. An empty table gives an empty result.
    """
    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).dropna().distinct(), "edges"
    )
    nodes = edges.where("a = b").select(F.col("a").alias("node"))
    edges = edges.where("a > b")
    seen = None
    while True:
        old = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
        edges = materialize(both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        middle, first = edges, low
        low = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = edges.join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for read in (middle, first, low, *([old] if seen else [])):
            drop(read)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    linked = stars.unionByName(roots)
    alone = nodes.join(linked.hint("merge"), "node", "left_anti").distinct().select("node", F.col("node").alias("root"))
    return linked.unionByName(alone)
