"""Connected components of a graph of 64-bit nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetrail.llm.work import materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, least): every edge with the least of u and its neighbours v; aggregated first, so a node of many edges is no single task."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("least"))
    return edges.join(least, F.col("u") == F.col("node")).select("u", "v", "least")


def _is_stars(edges: DataFrame) -> bool:
    """True if every u hangs on one v, and no v hangs on another."""
    tops = edges.select(F.col("v").alias("u")).distinct().withColumn("top", F.lit(True))
    return edges.groupBy("u").count().join(tops, "u", "left").filter("count > 1 OR top").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of an edge (a, b) reaches. Rounds grow with the logarithm of a path's length."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now = materialise(now, "components")
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u > v").distinct()
        # every u now hangs on smaller nodes: all of them and u itself move to the least of them
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        now = materialise(small.filter("u > v").distinct(), "components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
