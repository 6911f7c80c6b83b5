"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: each node's greater neighbours are linked to the least of it and its neighbours.
    Small: its lesser neighbours and itself are."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u != m").select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (columns a, b); the component is its least node.

    Every pass is a few keyed aggregations and joins over the links; their number grows with the logarithm of the
    diameter. Each pass is stored, so the plan stays small and a lost executor costs one pass.
    """
    edges, seen = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        after = stored(_star(_star(edges, True), False), "edges")
        forget(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
