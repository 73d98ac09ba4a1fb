"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haptrace.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, component): the smallest node that each node reaches.

    Nodes without an edge are absent; loops and repeated edges count for nothing. Each round hangs
    all larger neighbours of a node, then all smaller ones, on the smallest neighbour; so paths
    shrink by a constant factor and every node ends on its smallest one. Rounds are cut by reliable
    checkpoints. A node with very many neighbours is met in joins that split skewed keys.
    """
    ordered = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = cut_lineage(ordered)
    mark = _mark(state)
    while True:
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = cut_lineage(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = _mark(state)
        if now == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums that tell whether the edge set has changed."""
    hashed = F.xxhash64("a", "b")
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.pmod(hashed, F.lit(1 << 31))), F.sum(F.pmod(F.shiftrightunsigned(hashed, 31), F.lit(1 << 31))),
    ).first())
