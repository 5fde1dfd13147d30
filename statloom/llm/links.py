"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step gives every vertex the smallest neighbour as its star's centre; steps repeat until all edges are stars,
which takes a number of rounds that grows with the logarithm of the longest path. Every step is written to the shared
folder, and stars are made by joins that Spark can split, so that a centre with very many neighbours is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(edges: DataFrame, large: bool, bound: int) -> DataFrame:
    """edges (u, v), each undirected edge once, as (larger, smaller); a step never adds to their number, bound."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    centre = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), 2 * bound)
    joined = both.join(centre.hint("merge"), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(centre.select("u", F.col("m").alias("v")))
    return saved(out.where("u <> v").distinct(), bound)


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component): each vertex of edges (a, b) with the smallest vertex it can reach. No edges give no rows."""
    bound = edges.count()
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), bound)

    def settled(e: DataFrame) -> bool:
        """Whether every vertex has one neighbour, or is the centre that they share."""
        n, vertices = e.agg(F.count("*"), F.count_distinct("u")).first()
        return n == vertices and not e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").count()

    while not settled(now):
        now = _star(_star(now, True, bound), False, bound)
    return saved(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct(), 2 * bound)
