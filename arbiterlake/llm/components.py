"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("_m")))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("_m")))
    moved = down.join(least, "a").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``edges`` (columns ``a``, ``b``: long).

    Each step joins edges with the minimum of their end's neighbours. The minimum combines before the shuffle
    and is written before the join, so that the join is of known size and plain: broadcast if small, else
    with the edges of a node that has very many split over tasks (adaptive skew join). The number of rounds
    grows with the logarithm of the longest path. Loops are ignored; an empty table has no nodes.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    for _ in range(rounds):
        old, now = now, materialize(_small_star(_large_star(now)))
        forget(old)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
