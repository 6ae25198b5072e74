"""Best-fit decreasing packing of token sequences into bins of a fixed capacity.

Pieces are placed from the longest to the shortest, each into the bin with the least room that
still holds it. Pieces of one length are alike, and so are bins with the same room; so the
driver places runs of alike pieces into runs of alike bins, and finds the tightest room by a
segment tree over the capacities 0..capacity. Its work depends on the capacity and not on
the number of documents; the placement of every piece is what placing one at a time gives.
A piece finds its run from its rank among the pieces of its length. The ranks come from a count
per length and group of tasks, so that no length has to meet in one task.

Cases: a null text is empty and has the end id only; a text longer than the capacity is cut into full
pieces and a rest; ties of length go in any order; equal ids are documents of their own; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch
from sparkwire.llm.tokenids import encoder

_RUNS = "r_length long, rank_from long, rank_to long, bin long, per_bin long, offset long"


class RoomTree:
    """Which rooms 0..capacity have bins; a node is set if any leaf below is."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, room: int, value: bool) -> None:
        i = room + self.leaves
        self.any[i] = value
        while i > 1:
            i >>= 1
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def tightest(self, least: int) -> int | None:
        """The smallest room >= least that has bins."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first bin, pieces a bin, offset) of each run.

    The piece of rank r lies in bin ``first + (r - from) // per_bin`` at ``offset + (r - from) % per_bin * length``.
    """
    tree, bins = RoomTree(capacity), {}  # room -> runs of bins (first, number)
    runs, n_bins = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            bins.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, n_bins
                n = -(-left // (capacity // length))
                n_bins += n
            else:
                first, n = bins[room].pop()
                if not bins[room]:
                    tree.set(room, False)
            per = room // length
            full, rest = min(n, left // per), 0
            placed = full * per
            if full < n and placed < left:
                rest = left - placed
                placed = left
            runs.append((length, at, at + placed, first, per, capacity - room))
            add(room - per * length, first, full)
            if rest:
                add(room - rest * length, first + full, 1)
            add(room, first + full + (rest > 0), n - full - (rest > 0))
            at, left = at + placed, left - placed
    return runs


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int"
_PIECE_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def pieces(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Every piece, with the task that made it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        for b in batches:
            doc_ids = b.column(0)
            for lo, ids, offsets in enc.of_column(b.column(1), end_id):
                n = -(-np.diff(offsets) // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                begin = offsets[doc] + piece * capacity
                end = np.minimum(begin + capacity, offsets[doc + 1])
                data = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, len(n)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(end - begin),
                     pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32())],
                    names=_PIECE_NAMES,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return scratch.table(rows.mapInArrow(run, _PIECE), "pieces")


def pack(
    docs: DataFrame,
    scratch: Scratch,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = 4096,
    groups: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    made = pieces(docs, scratch, tokenizer, end_id, capacity, id_col, text_col)
    # tasks are dealt into groups, whose number does not grow: a length may have a third of all pieces, but none of its groups
    made = made.withColumn("part", F.col("part") % groups)
    sums = scratch.table(made.groupBy("length", "part").agg(F.count("*").alias("n")), "sums")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("part").alias("b_part"), F.col("length").alias("b_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most a row per length of 1..capacity and group
    base = scratch.table(base, "bases")
    # at most one row per length comes to the driver
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = scratch.table(spark.createDataFrame(best_fit(counts, capacity), _RUNS), "runs")
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("nth", F.row_number().over(inside) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("b_length")) & (F.col("part") == F.col("b_part")))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth"))
    hit = (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    within = F.col("rank") - F.col("rank_from")
    return ranked.join(runs, hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(within / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("offset") + within % F.col("per_bin") * F.col("length")).alias("offset"),
    )
