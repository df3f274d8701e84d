"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwise.session import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge, but for the roots: the smallest
    node of each component. ``edges``: ``u`` and ``v``, long, in any order, with
    repeats and loops. Each round is a few aggregations and joins on node ids, its
    result a table; rounds grow with the logarithm of the longest path. A hub's
    edges may be split over tasks in the joins, and sums are combined first."""
    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while (state := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != seen:
        seen = state
        if not state[0]:
            break
        now = materialize(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node meet the smallest of its neighbourhood."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours meet the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    ends = e.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.where("u != v").distinct()
