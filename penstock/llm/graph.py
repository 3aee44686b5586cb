"""Connected components of a table of links, by alternating star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(edges: DataFrame) -> bool:
    """Whether each node is either a root or has one link, to a root: then the links are the answer and no round is needed to confirm it."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    sums = ends.groupBy("n").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
    return sums.filter("below > 1 or (below > 0 and above > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: comparable ids); root is the smallest node reachable.

    Large-star and small-star rounds: minima are written tables, so the join of a hub is one that Spark can split; nothing is
    collected but one yes or no a round; each round is a written table, so a lost executor costs one round at most.
    """
    edges = materialise(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not _stars(edges):
        # large star: each neighbour above a node points to the node's smallest neighbour
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
        large = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b")
        large = materialise(large.filter(F.col("a") != F.col("b")).distinct(), "large")
        # small star: each node and its smaller neighbours point to the smallest of them
        low = materialise(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m"), "low")
        small = large.join(low, F.col("b") == F.col("n")).select(F.col("m").alias("x"), F.col("a").alias("y"))
        small = small.unionByName(low.select(F.col("m").alias("x"), F.col("n").alias("y"))).filter(F.col("x") != F.col("y"))
        edges = materialise(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "small")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
