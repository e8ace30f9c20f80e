"""Distributed union-find: connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is the larger end of one edge, or the smaller end of some, but not both."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return nodes.where("up > 1 or up = 1 and least = 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, label), label the smallest node of the component.

    Nodes without an edge to another node are absent. Loops, repeated and null edges are dropped. Only minima are
    gathered per node, never neighbour lists, so hubs need no memory; what reaches the driver is whether all are stars.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(e):
        back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = e.unionByName(back).groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        low = materialize(low, "low")
        # A hub is the smaller end of many edges: those are the hot keys.
        large = join_hot(back, low.select("a", "m"), "a", low.select("a", "n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = e.join(low, "a").where("a <> m").select("a", F.col("m").alias("b"))
        star = large.unionByName(kept).distinct()
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(e, low)
        e = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
