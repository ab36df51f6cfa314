"""Connected components of links between long ids, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialize

#: Rounds after which an unfinished contraction is an error; each round shortens paths geometrically.
ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node's neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these; a < b in every edge."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return tied.union(least.select("m", "b")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for each end of an edge (a, b); loops and repeats are ignored.

    Nothing of the edges reaches the driver but whether they are stars yet.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialize(edges, "links")
    for _ in range(ROUNDS):
        # stars only: no leaf has two centres or is a centre itself
        roles = edges.select(F.col("b").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select("a", F.lit(0), F.lit(1)))
        sums = roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        if not sums.where("leaf > 1 OR (leaf = 1 AND centre = 1)").limit(1).count():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a"), F.col("a")).distinct())
        edges = materialize(_small_star(_large_star(edges)), "links")
    raise RuntimeError("components: no end after the allowed rounds")
