"""Connected components of links, by stars: linear rows per round, few rounds, nothing on the driver but two numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, written


def _mark(edges: DataFrame):
    """Two numbers that tell whether a set of edges has changed."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b): the component is the least id that can be reached.

    Each round ties every node's larger neighbours to its least neighbour, then every node's smaller ones; the
    edges become stars around the least ids. Minima are written first, so that joins with hot ids stay joins of
    two tables, which Spark can split. Links of an id with itself, repeated ones and either direction are fine.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        # v > u holds of an edge's reverse only; u's least neighbour may be u itself.
        large = written(edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "edges")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        star = written(small.distinct(), "edges")
        now = _mark(star)
        for table in (edges, least, large, lower):
            forget(table)
        edges = star
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        mark = now
