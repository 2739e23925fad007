"""Connected components of very large graphs: alternating large-star and small-star."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuloom.session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (its greater ones, or its smaller ones and itself) move to its least neighbour.

    Least neighbours come from an aggregation that combines before its shuffle. The join that takes
    them back is on the nodes' complements, by which nothing is partitioned yet: so it has an
    exchange of its own on both sides, and a node with very many neighbours can be split in it.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m"))
    moved = both.join(least, F.bitwise_not("a") == F.bitwise_not("n"))
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # a > b: b and a itself hang on the least of a's smaller neighbours
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """edges (a, b) -> node, root: the least node of its component, whose own root it is. Nodes without an edge don't occur."""
    now = scratch.table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), f"{name}-0"
    )
    for k in count(1):  # every round shrinks what is unsettled; a component of n nodes takes O(log n) squared at most
        # a node of two smaller neighbours, or a least node that hangs on another, means more to do
        done = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0
        if done and now.join(now.select(F.col("a").alias("c")), F.col("b") == F.col("c"), "left_semi").limit(1).count() == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        new = scratch.table(_star(_star(now, True), False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = new
