"""Connected components of an edge list by alternating star contractions, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywise.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns (node, root) for every node of an edge; root is the smallest node of its component.

    Loops, repeated and null-ended edges change nothing. Each round is written to the shared folder,
    so a lost executor costs one round. Nodes of very high degree cross the joins as skewed keys,
    which adaptive execution splits, and the groupings as partial minima.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = stored(edges)
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)))
        after = _state(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select("v", "v")).distinct()
