"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours now point to its smallest neighbour or itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours now point to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and none where it is one itself."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter((F.col("up") + F.col("down") > 1) & (F.col("up") > 0)).isEmpty()


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b): root is the least node of its component.

    Union-find over partitions: alternating large-star and small-star rounds, each reducing
    per node before rows meet, until the edges are stars. A round's
    edges are a written table, so that a lost executor costs one round at most.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, turn = scratch.table(ordered, "edges-0"), 0
    while not _is_star_forest(edges):
        turn += 1
        edges = scratch.table(_small_star(_large_star(edges)), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
