"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours v.  A grouping and a join, which adaptive execution can split where u is hot."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
    return edges.join(least, edges["u"] == least["_u"]).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, in any direction; the result has each node that has an edge to another: node, root (the least node)."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = _least(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v")))
        now = cut(small.where("u != v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
