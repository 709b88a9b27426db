"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.session import cut

#: Rounds grow with the logarithm of the longest path; this bound is far beyond that and only stops a fault.
MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b) with the least node it can reach.

    Each round hangs every node's larger neighbours on its least neighbour, then every node and its smaller neighbours
    on the least of them, and writes the edges. A node's neighbours are never listed: least neighbours are aggregates
    that combine before the shuffle, and the joins are ones that adaptive execution can split for frequent nodes.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        now = cut(_small_star(cut(_large_star(now))))
        state, before = _state(now), state
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")


def _state(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
