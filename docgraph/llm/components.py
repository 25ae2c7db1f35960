"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node (large: those above it) on the least of them and it."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(flipped) if large else flipped
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else near.groupBy("a").agg(F.min("b").alias("m"))
    joined = near.join(least, "a")
    if large:
        hung = joined.filter("b > a").select("b", "m")
    else:
        hung = joined.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    return hung.filter("b <> m").select(F.col("m").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node with an edge: comp is the least node that it reaches.

    edges: columns a and b of an ordered type, in any direction, repeats and loops allowed. Every round is written to
    the shared folder; hot nodes only meet in minima, which are aggregated before the shuffle, and in joins on one side.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    mark = None
    while True:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not found["n"] or mark == tuple(found):
            break
        mark = tuple(found)
        edges = materialize(_star(_star(edges, True), False), "edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())
