"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut


#: Edges that one task holds at least: few edges are not spread over all shuffle partitions.
EDGES_TOGETHER = 500_000


def _star(edges: DataFrame, both_ways: bool, tasks: int) -> DataFrame:
    """Large star (both ways): larger neighbours move to the least one. Small star: the smaller ones do."""
    if both_ways:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    # materialised, so that the join has shuffles of its own on both sides and AQE can split a hub
    least = cut(near.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).coalesce(tasks))
    moved = near.join(least.hint("merge"), "a")
    if both_ways:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b")))
    return cut(out.where("a <> b").distinct().coalesce(tasks))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; ``root`` is the least node of its component.

    ``edges(a, b)`` are undirected. Loops and nulls are ignored, repeated edges count once. Every round is
    written to the checkpoint folder; rounds grow with the logarithm of the longest path.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = cut(now), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark, tasks = seen, 1 + seen[0] // EDGES_TOGETHER
        now = _star(_star(now.coalesce(tasks), True, tasks), False, tasks)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b"), F.col("b")).distinct())
