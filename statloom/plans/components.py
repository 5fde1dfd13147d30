"""Connected components of an edge table, by giving each vertex the smallest neighbour's label in large and small steps.

Steps repeat until all edges are stars, which takes a number of rounds that grows with the logarithm of the longest path.
Each is checkpointed in the folder of spark.checkpoint.dir, so a lost executor costs one step.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint. Where no folder is set and all runs on one machine, as in tests, a
    temporary one is."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp())
    return df.checkpoint()


def _step(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    centre = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(centre, "u")
    moved = joined.where("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = moved if large else moved.union(centre.select("u", F.col("m").alias("v")))
    return kept(out.where("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component): each vertex of edges (a, b) with the smallest vertex it can reach. No edges give no rows."""
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        n, vertices = now.agg(F.count("*"), F.count_distinct("u")).first()
        if n == vertices and now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        now = _step(_step(now, True), False)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
