"""Connected components of links, by alternating large and small stars; every round is joins and aggregations on the links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwire.operators.scan import pinned


def components(links: DataFrame, pin: Callable[[DataFrame], DataFrame] = pinned) -> DataFrame:
    """(node, root) of every node of (a, b) that has a link to another; the root is the least node reachable.

    Rounds grow with the logarithm of the longest path. The driver sees two sums a round.
    """
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = pin(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = sign(edges)
    while now[0]:
        # large star: all neighbours above a node are tied to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "k")
        large = pin(both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: all neighbours below a node, and the node, to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = pin(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        was, now = now, sign(edges)
        if was == now:
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
