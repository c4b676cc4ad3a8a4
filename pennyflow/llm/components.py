"""Connected components of a table of links, as alternating star contractions over joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """A stored table of every node of ``links`` (long columns a, b) with ``component``, the smallest node it reaches.

    Each round joins every node's larger neighbours, then its smaller ones, to the smallest of them.
    The rounds needed grow with the logarithm of the longest chain; links that are stars already
    need two. A round's table replaces the last in the shared folder, nothing goes to the driver but
    two numbers. Links from a node to itself only make it a node; null ends are dropped.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, stored(moved.unionByName(lowest.withColumnRenamed("m", "b")).distinct())
        dropped(last)
        now = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.withColumnsRenamed({"a": "node", "b": "component"})
            found = stored(nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
            dropped(edges)
            return found
        before = now
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
