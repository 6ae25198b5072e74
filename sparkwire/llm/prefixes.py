"""The trie of conversation prefixes, without building it: every node is owned by its smallest member.

A conversation that is the smallest member of a node is the smallest of all nodes below it on its path, so each conversation
owns a suffix of its path, told by one number: the depth at which it begins. What a subtree saves is then a sum over members
alone: the tokens of all occurrences in the subtree less those of the nodes, each counted at its owner. So is its number of
leaves (a flag of the owner) and of children. One group-by on the prefix gives all of them.

The owner of a prefix is the least id by a grouped minimum, which merges on the map side, in place of a window over the
prefix: the root's window would hold every conversation. The windows over a conversation's turns are prefix scans by range
partitions (:mod:`sparkwire.operators.scan`), so one conversation may hold most rows. A prefix is known by sums of SHA-256
parts of (place, turn), 240 bits, and each node's members are checked to have one last turn, so by induction one prefix: a
collision stops the query and gives no wrong row.

Defined results: rows without ``conv_id`` belong to no conversation and are left out. Turns of one number, or of none, come in the order of
role, then of the SHA-256 of role and text; repeated rows are turns of their own. Null role and text are empty. An empty table has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch
from sparkwire.operators.scan import running

_LIMBS = 4
_CHUNK_BITS = 12  # ids that share all but these bits are joined to one text first


def borrowed_turns(conv: Column) -> Column:
    """How many first turns a rebuilt conversation takes from its base."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def base_of(conv: Column) -> Column:
    return conv - conv % 5


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, digest of role and text, bytes of text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.sha2(framed, 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(numbered: DataFrame) -> DataFrame:
    """(conv, depth, digest, bytes) from (conv, place from 0, digest, bytes): the base's first turns, then the own ones after as many."""
    most = 8
    convs = numbered.select("conv").distinct().select("conv", borrowed_turns(F.col("conv")).alias("h"), base_of(F.col("conv")).alias("base"))
    first = numbered.where(F.col("place") < most).select(F.col("conv").alias("base"), "place", "digest", "bytes")
    lent = convs.join(first, "base").where(F.col("place") < F.col("h")).select("conv", (F.col("place") + 1).alias("depth"), "digest", "bytes")
    sizes = first.groupBy("base").agg(F.count("*").alias("n"))
    start = convs.join(sizes, "base", "left").select(F.col("conv").alias("c"), F.least("h", F.coalesce("n", F.lit(0))).alias("lent"))
    own = numbered.where(F.col("place") >= borrowed_turns(F.col("conv"))).join(start, F.col("conv") == F.col("c"))
    depth = F.col("lent") + F.col("place") - borrowed_turns(F.col("conv")) + 1
    return lent.unionByName(own.select("conv", depth.alias("depth"), "digest", "bytes"))


def _node(depth: Column, limbs: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", depth.cast("string"), *[x.cast("decimal(38,0)").cast("string") for x in limbs]), 256))


def occurrences(steps: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, node, parent, digest, bytes, before): each place of each path with its prefix and the bytes above it, the root included."""
    place = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.col("digest")), 256)
    names = [f"limb{i}" for i in range(_LIMBS)]
    own = {n: F.conv(F.substring(place, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)") for i, n in enumerate(names)}
    sums = running(steps, [F.col("depth")], own | {"before": F.col("bytes")}, key=("conv",), pin=lambda df: scratch.table(df, "paths"))
    after = [F.col(n).cast("decimal(38,0)") + own[n] for n in names]
    there = sums.select(
        "conv", "depth", _node(F.col("depth"), after).alias("node"), _node(F.col("depth") - 1, [F.col(n) for n in names]).alias("parent"), "digest", "bytes", F.col("before").cast("long").alias("before")
    )
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), _node(F.lit(0), [F.lit(0)] * _LIMBS).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit("").alias("digest"), zero.alias("bytes"), zero.alias("before"))
    return there.unionByName(root)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's parts, which come one after the other."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends"])

    for batch in batches:
        for at, part in zip(batch.column("node").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if at != node:
                if node is not None:
                    yield row()
                node, digest = at, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(part.encode())
    if node is not None:
        yield row()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends) from (node, conv): the digest of the ids in numeric order. Ids are joined in short runs by many tasks, and only
    the runs' texts pass the one hash of a node, one after the other."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("node", F.shiftright("conv", _CHUNK_BITS).alias("run")).agg(ids.alias("part"))
    return parts.repartition("node").sortWithinPartitions("node", "run").mapInArrow(_hashed, "node binary, ends string")


def trie(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each node: smallest member, depth, parent's smallest member, members, children, leaves below, bytes saved below, digest of the conversations that end there."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    numbered = running(turns(conversations), order, {"place": F.lit(1).cast("long")}, key=("conv",), pin=lambda df: scratch.table(df, "turns"))
    numbered = scratch.table(numbered.select("conv", "place", "digest", "bytes"), "numbered")
    convs = scratch.table(numbered.select("conv").distinct(), "convs")
    there = scratch.table(occurrences(rebuilt(numbered), convs, scratch), "occurrences")

    paths = there.groupBy("conv").agg(F.max("depth").alias("length"), F.sum("bytes").alias("total"), F.max_by("node", "depth").alias("node"))
    paths = scratch.table(paths, "path-ends")
    # members that differ in their last turn would be two prefixes with one hash
    members_of = F.when(F.min("digest") == F.max("digest"), F.count("*")).otherwise(F.raise_error(F.lit("two prefixes with one hash")).cast("long"))
    nodes = there.groupBy("node").agg(F.min("conv").alias("owner"), members_of.alias("n_convs"), F.min("depth").alias("depth"), F.min("before").alias("before"), F.min("parent").alias("parent"))
    ended = paths.groupBy("node").agg(F.count("*").alias("n_ends"))
    nodes = nodes.join(ended, "node", "left").withColumn("is_leaf", F.coalesce(F.col("n_ends") == F.col("n_convs"), F.lit(False)))
    nodes = scratch.table(nodes.select("node", "owner", "depth", "before", "parent", "is_leaf"), "nodes")

    owned = nodes.groupBy(F.col("owner").alias("conv")).agg(F.min("depth").alias("owned_from"), F.min_by("before", "depth").alias("shared"), F.max(F.col("is_leaf").cast("long")).alias("leaf"))
    members = paths.select("conv", "length", "total").join(owned, "conv", "left")
    members = members.select("conv", "length", "owned_from", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    members = scratch.table(members, "members")

    below = F.col("depth") + 1
    child = F.coalesce((F.col("owned_from") <= below) & (below <= F.col("length")), F.lit(False)).cast("long")
    each = there.select("conv", "depth", "node", "before").join(members, "conv").select(
        "conv", "depth", "node", F.greatest(F.col("shared") - F.col("before"), F.lit(0)).alias("saved"), "leaf", child.alias("child")
    )
    sums = each.groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    sums = sums.join(ends_digests(paths.select("node", "conv")), "node", "left")
    sums = scratch.table(sums, "sums")
    up = nodes.join(nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id")), "parent", "left").select("node", "parent_conv_id")
    return sums.join(up, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )
