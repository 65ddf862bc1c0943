"""Connected components of an edge table (large-star / small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root): the smallest node of its component, for
    every node with an edge.  Nodes of any orderable type.

    Each round shuffles edges only.  Neighbour minima are combined before
    the shuffle, and the joins' hot nodes are left to skew splitting; edges
    are never grouped into lists.  Rounds grow with the log of the component size."""
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = materialise(both, "cc-edges")
    while True:
        # large star: greater neighbours of a node to the smallest of its closed neighbourhood
        sides = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: lesser neighbours (and the node) to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        grown = materialise(small.filter("a <> b"), "cc-edges")
        # stars remain when no node has two parents or is both parent and child
        parents = grown.groupBy("a").agg(F.count("*").alias("n"))
        mixed = grown.select(F.col("b").alias("a")).distinct().join(parents, "a", "left_semi")
        if parents.filter("n > 1").isEmpty() and mixed.isEmpty():
            break
        both = grown
    return grown.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        grown.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
