"""Connected components by alternating large-star and small-star steps.

Edges are rows (u, v); a step moves edges towards the smallest neighbour. Neighbour minima are aggregates that are
combined before the shuffle and joined back, so no node's neighbours meet in one task as a list, and Spark can split the
join at a hot node. Every round is settled in the shared folder; the loop ends when a round changes nothing, which a
count and a sum of hashes tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshift.llm.common import settle


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its v."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    return (starred.select("u", F.col("m").alias("v"))
            .unionByName(starred.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u <> v").distinct())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    edges: two columns of one type; loops and repeated edges do no harm, edges with a null do not count. An input
    without edges gives an empty result.
    """
    a, b = edges.columns
    edges = settle(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        edges = settle(small_star(large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(centres)
