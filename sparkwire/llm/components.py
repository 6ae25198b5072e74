"""Connected components of a link table by alternating large and small stars.

Each round is joins and aggregations on the links; nothing is held by the driver but two sums.
A node with very many links is met by partial aggregation, and by joins against tables that have
been written, so that adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """``edges`` has u > v. The result has u > v again, each edge once."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = scratch.table(least.withColumnRenamed("u", "k"), "least")
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        out = out.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")))
    out = scratch.table(out.distinct(), "star")
    scratch.drop(least)
    return out


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connect(links: DataFrame, scratch: Scratch) -> DataFrame:
    """From (a, b): (node, root) of every node with a link to another, root the least id reachable."""
    e = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.table(e.distinct(), "edges")
    now = _sum(e)
    while now[0]:
        wide = _star(e, scratch, large=True)
        narrow = _star(wide, scratch, large=False)
        scratch.drop(e, wide)
        e, was, now = narrow, now, _sum(narrow)
        if was == now:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
