"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    near = both.join(least.hint("merge"), "a").where("b > a")
    return near.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least.hint("merge"), "a")
    moved = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it can reach, for every node with an edge to a smaller component member.

    ``edges`` has two long columns ``a`` and ``b`` in any direction.  Every round is written to the shared
    folder; rounds grow with the logarithm of the longest path.  A node of very high degree is
    pre-aggregated for its minimum, and its edges are split by the adaptive skew join.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        following = stored(_small_star(_large_star(current)), "edges")
        seen = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(current)
        current = following
        if state == tuple(seen):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
