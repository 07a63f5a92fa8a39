"""Connected components of an edge table, without gathering it anywhere.

Alternates large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"), each a grouped minimum and a join; every
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connects each node's neighbours to the least of them and the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("n", "m").alias("m"))
    met = both.join(least, F.col("a") == F.col("n"))
    if large:
        return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``a, b`` (longs) to ``node, component``: the least node that each reaches."""
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = materialise(edges, "edges"), None
    if edges.isEmpty():
        return edges.toDF("node", "component")
    while True:
        new = materialise(_star(_star(edges, True), False), "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(edges)
        edges = new
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
