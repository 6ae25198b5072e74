"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``vnodes`` points on a 2^32 ring, and owns the arcs that end in them. A row
stands at a hash of its text and belongs to the arc it lies in; a shard holds n // shards rows
or one more, and rows past that continue clockwise to the next shard with room. So counts
are at most one apart, and only overflow moves when rows or shards come. Equal texts stand at one
place of the ring, and so come to one shard, or to the next ones clockwise where it is full.

Rows are counted by arc in Spark. The ring is a fixed number of arcs, whatever the table's
size, so the driver can walk it and gives, for each arc, which ranks go to which
shard. A row finds its place from its rank in its arc; no row is seen by the driver. For the ranks an
arc is cut into cells of the ring and a cell is dealt by the rows' hashes, so that many equal texts
don't meet in one task.

Cases: a null text has no bytes and stands where the empty text does; equal ids are ordered by
size and checksum, and wholly equal rows in any order; rows without an id are dealt by their place in the
input; an empty table gives an empty one; columns of ``docs`` may have any names.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch

_SEGMENTS = "seg_arc int, rank_from long, rank_to long, shard int, slot_from long"


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) by point; where a point is taken, the lower shard keeps it."""
    points: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:4], "big")
            points.setdefault(at, s)
    return sorted(points.items())


def walk(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of each arc go to which shard: (arc, from, to, shard, slot of from).

    ``owners[a]`` owns arc a. Every shard first takes what its own arcs hold, up to its
    capacity and in ring order; then the overflow of each arc goes on clockwise.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, over = [0] * shards, [], []

    def put(arc: int, start: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n > 0:
            out.append((arc, start, start + n, shard, used[shard]))
            used[shard] += n
        return max(n, 0)

    for arc, shard in enumerate(owners):
        n = counts.get(arc, 0)
        done = put(arc, 0, n, shard)
        if done < n:
            over.append((arc, done, n))
    for arc, start, n in over:
        at = arc
        while start < n:
            at = (at + 1) % len(owners)
            start += put(arc, start, n - start, owners[at])
    return out


def place(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, vnodes: int = 128, deal: int = 16
) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark: SparkSession = docs.sparkSession
    nodes = ring(shards, vnodes)
    points = [p for p, _ in nodes]
    # Each of 2^12 equal cells of the ring holds few points: an arc is found from its cell's first one.
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 32).alias("at"),
    )
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "size", "text_crc32"))
    # The arc of a place is the number of points below it; past the last point the ring closes at arc 0.
    cells = 1 << 12
    first = [bisect.bisect_left(points, c << 20) for c in range(cells)]
    widest = max(b - a for a, b in zip(first, [*first[1:], len(points)], strict=True))
    lookup = F.element_at(F.lit(np.array(first, dtype=np.int64)), F.shiftright("at", 20).cast("int") + 1)
    ends = F.lit(np.array([*points, *[1 << 32] * (widest + 1)], dtype=np.int64))
    arc = lookup
    for j in range(widest):
        arc = arc + F.when(F.element_at(ends, (F.col("first") + (j + 1)).cast("int")) < F.col("at"), 1).otherwise(0)
    rows = rows.withColumn("first", lookup).withColumn("arc", (arc % len(points)).cast("int")).withColumn("cell", F.shiftright("at", 20).cast("int"))
    rows = scratch.table(rows.withColumn("deal", F.pmod(own, F.lit(deal)).cast("int")).drop("first"), "placed")
    # at most a row per arc or cell of the ring and deal
    group = ["arc", "cell", "deal"]
    sums = scratch.table(rows.groupBy(*group).agg(F.count("*").alias("n")), "sums")
    # one row per arc of the ring: bounded by shards * vnodes
    counts = {r["arc"]: r["n"] for r in sums.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    segments = spark.createDataFrame(walk(counts, [s for _, s in nodes], shards), _SEGMENTS)
    before = Window.partitionBy("arc").orderBy("cell", "deal").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"b_{c}") for c in group], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy(*group).orderBy("at", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(order) - 1)
    ranked = ranked.join(base, (F.col("arc") == F.col("b_arc")) & (F.col("cell") == F.col("b_cell")) & (F.col("deal") == F.col("b_deal")))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth"))
    hit = (F.col("arc") == F.col("seg_arc")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    # at most 2 * shards * vnodes + shards segments of 28 bytes: each one ends an arc or fills a shard
    return ranked.join(F.broadcast(segments), hit).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot_from") + F.col("rank") - F.col("rank_from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
