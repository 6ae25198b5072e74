"""Near-duplicate embeddings by collision counting on one-dimensional projections.

Vectors are scaled to length one and projected on ``lines`` random directions. Two vectors of
cosine c differ on a line by a normal amount of variance 2 - 2c (for random directions), so with a
window of ``window`` deviations around a query's place, a pair at the limit collides on a line with a
known chance. A pair goes to verification when it collides on at least ``least`` lines; ``least``
is the count that all but ``miss`` of the pairs at the limit reach.

Lines are sorted and windows counted inside neighbourhoods, as a single line cannot tell a large
table apart: each of ``tables`` tables cuts ``dims`` of the lines into cells of width ``cell`` at a random
shift, and vectors of one label that share a cell in some table are neighbours. A pair at the limit
shares a cell of a table with chance (1 - E|d| / cell)^dims, about 0.3 here, others with 3e-5; there are so many tables that
limit pairs miss all of them with a chance of the order of ``miss`` too (simulated, see the README). In a neighbourhood the vectors
are sorted on one line, the window around each query gives its first candidates, and the
other lines are counted for those, dropping a pair as soon as it can no longer reach ``least``.
A pair is counted in the first table that has it in one cell and in one window of the line it sorts
by (table t sorts by line t modulo ``lines``), so links are counted once without writing pairs out: a task gives each
vector its number of links, and a star of links for the components.

Equal vectors of one label are one class, compared once and counted by its number. Places on lines are whole numbers of
1 / 512, from which cells follow exactly wherever they are computed; a row that is shuffled holds a vector as it
came and its places. A cell with more than ``block`` classes is worked off in blocks against blocks, spread over tasks.

Cases: a vector that is null, empty, zero, or holds null or non-finite components, and one whose label or id is null, is
linked with nothing; vectors of different lengths are never compared; equal vectors are linked like any
others; ids that repeat are vectors of their own in the counts and one node in the components; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire.llm.components import connect
from sparkwire.llm.scratch import Scratch


@dataclass(frozen=True)
class Counting:
    cosine: float = 0.98
    lines: int = 32
    window: float = 2.5
    miss: float = 1e-6
    tables: int = 64
    dims: int = 10
    cell: float = 1.4
    block: int = 512
    together: int = 4096
    seed: int = 11

    @property
    def reach(self) -> float:
        """The standard deviation of a limit pair's difference on a line."""
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def least(self) -> int:
        """The largest count that limit pairs miss with a chance of at most ``miss``."""
        p = math.erf(self.window / math.sqrt(2))
        below, m = 0.0, 0
        while m < self.lines:
            below += math.comb(self.lines, m) * p**m * (1 - p) ** (self.lines - m)
            if below > self.miss:
                break
            m += 1
        return m


_APART = 1 << 20  # what separates the places of two cells
_PAIRS = 1 << 16  # candidates at once
STEP = 512  # places on a line are counted in 1 / STEP


@cache
def directions(dim: int, c: Counting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, the lines of each table, the shift of each table and line)."""
    rng = np.random.default_rng([c.seed, dim])
    a = rng.standard_normal((dim, c.lines))
    picks = np.stack([rng.choice(c.lines, min(c.dims, c.lines), replace=False) for _ in range(c.tables)])
    return a, picks, (rng.random((c.tables, picks.shape[1])) * c.cell * STEP).astype(np.int64)


def cells_of(places: np.ndarray, dim: int, c: Counting) -> np.ndarray:
    """A hash of the cell in each table, from the places on all lines."""
    _, picks, shift = directions(dim, c)
    cells = (places.astype(np.int64)[:, picks] + shift[None]) // round(c.cell * STEP)
    keys = np.full(cells.shape[:2], dim, np.int64)
    for j in range(cells.shape[2]):
        keys = (keys ^ cells[:, :, j]) * np.int64(0x100000001B3) + (keys >> 29)
    return (keys ^ (keys >> 32)).astype(np.int32)


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that can link, and their vectors scaled so that no square overflows or vanishes, in double precision."""
    rows, out = [], []
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(valid):
        values = column[int(i)].values
        if values is None or len(values) == 0 or values.null_count:
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            continue
        rows.append(int(i))
        out.append(v / top)
    return np.array(rows, np.int64), out


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _places(c: Counting, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, vectors = usable(b.column(2))
            sizes = np.array([len(v) for v in vectors], np.int64)
            for dim in np.unique(sizes):
                has = np.flatnonzero(sizes == dim)
                a = directions(int(dim), c)[0]
                places = np.clip(np.rint(_units(np.stack([vectors[i] for i in has])) @ a * STEP), -32767, 32767).astype(np.int16)
                raw = [b.column(2)[int(rows[i])].values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for i in has]
                at = pa.array(rows[has])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(has), dim, np.int32)), pa.array(raw, pa.binary()),
                     pa.array([p.tobytes() for p in places], pa.binary())],
                    names=["id", "label", "dim", "vector", "places"],
                )

    return run


def _cells(c: Counting):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                places = np.frombuffer(b"".join(b.column(2).take(at).to_pylist()), np.int16).reshape(len(at), -1)
                keys = cells_of(places, int(dim), c)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(list(keys), pa.list_(pa.int32()))], names=["node", "cells"])

    return run


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge by least index until every link's ends agree."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        differ = low < high
        if not differ.any():
            return
        np.minimum.at(parent, high[differ], low[differ])
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _block(c: Counting, kind: type):
    """A block of a cell: links of chunk i with chunk j, as (node, links) and a star (node, root)."""
    window, least = int(c.window * c.reach * STEP) + 1, c.least  # rounding takes a step at most from a difference

    def run(t: pa.Table) -> pa.Table:
        table, i, j, dim = (t[k][0].as_py() for k in ("table", "i", "j", "dim"))
        ids, chunk, weight = t["node"].to_numpy(), t["chunk"].to_numpy(), t["weight"].to_numpy()
        take = lambda name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind).reshape(len(ids), -1)
        x, places = _units(take("vector", kind).astype(np.float64)), take("places", np.int16).astype(np.int32)
        cells = cells_of(places, dim, c)
        # the first line in sorted order, cell by cell; a chunk is compared with itself or with another
        line = table % c.lines
        place = np.unique(t["cell"].to_numpy(), return_inverse=True)[1].astype(np.int64) * _APART + places[:, line]
        order = np.argsort(place, kind="stable")
        ids, chunk, weight, x, places, cells, place = (v[order] for v in (ids, chunk, weight, x, places, cells, place))
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        lo = np.searchsorted(place[right], place[left] - window, "left")
        hi = np.searchsorted(place[right], place[left] + window, "right")
        if i == j:
            lo = np.maximum(lo, np.arange(len(left)) + 1)  # each pair once
        collides = lambda q, o, k: np.abs(places[q, k] - places[o, k]) <= window
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        upto = np.concatenate([[0], np.cumsum(np.maximum(hi - lo, 0))])
        cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + _PAIRS, _PAIRS)))
        for s, to in zip(cuts[:-1], cuts[1:], strict=True):
            n = np.maximum(hi[s:to] - lo[s:to], 0)
            q = np.repeat(left[s:to], n)
            o = right[np.repeat(lo[s:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            count = np.ones(len(q), np.int32)
            for done, k in enumerate([k for k in range(c.lines) if k != line], start=2):
                count += collides(q, o, k)
                ok = count + (c.lines - done) >= least
                if not ok.all():
                    q, o, count = q[ok], o[ok], count[ok]
            for e in range(table):
                old = (cells[q, e] == cells[o, e]) & collides(q, o, e % c.lines)
                if old.any():
                    q, o = q[~old], o[~old]
            for v in range(0, len(q), 8192):
                a, b = q[v : v + 8192], o[v : v + 8192]
                hit = np.einsum("ij,ij->i", x[a], x[b]) >= c.cosine
                a, b = a[hit], b[hit]
                if len(a):
                    links += (np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))).astype(np.int64)
                    _union(parent, a, b)
        has = np.flatnonzero(links)
        least_id = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least_id, parent, ids)
        return pa.table({"node": ids[has], "links": links[has], "root": least_id[parent[has]]})

    return run


def near_duplicates(
    table: DataFrame, scratch: Scratch, c: Counting = Counting(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """A row per vector: id_col, n_links, component_id, kept."""
    spark_type = table.schema[vector_col].dataType.elementType.simpleString()
    kind = np.float32 if spark_type == "float" else np.float64
    rows = table.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    usable_rows = rows.where("id is not null and label is not null and v is not null")
    placed = usable_rows.mapInArrow(_places(c, kind), "id long, label string, dim int, vector binary, places binary")
    prints = [F.xxhash64("vector").alias("f1"), F.xxhash64(F.lit(1), "vector").alias("f2")]
    placed = scratch.table(placed.select("*", *prints), "placed")
    # equal vectors of a label are one class, whose node is its least id
    classes = placed.groupBy("label", "dim", "f1", "f2").agg(F.min("id").alias("c_node"), F.count("*").alias("weight"))
    classes = scratch.table(classes.select(F.col("label").alias("c_label"), F.col("dim").alias("c_dim"), F.col("f1").alias("c_f1"), F.col("f2").alias("c_f2"), "c_node", "weight"), "classes")
    same = (F.col("label") == F.col("c_label")) & (F.col("dim") == F.col("c_dim")) & (F.col("f1") == F.col("c_f1")) & (F.col("f2") == F.col("c_f2"))
    own = placed.join(classes, same & (F.col("id") == F.col("c_node"))).dropDuplicates(["label", "dim", "f1", "f2", "id"])
    # an id may stand for several vectors, so a class has a number of its own
    own = own.select(F.monotonically_increasing_id().alias("node"), "c_node", "label", "dim", "vector", "places", "weight", "f1", "f2")
    own = scratch.table(own, "own")
    cells = scratch.table(own.select("node", "dim", "places").mapInArrow(_cells(c), "node long, cells array<int>"), "cells")
    key = own.select(F.col("node").alias("o_node"), "label", "dim")
    wide = cells.join(key, F.col("node") == F.col("o_node")).select("node", "label", "dim", F.posexplode("cells").alias("table", "cell"))
    wide = scratch.table(wide, "wide")
    group = ["label", "dim", "table", "cell"]
    sizes = wide.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1")
    sizes = scratch.table(sizes.select(*[F.col(g).alias(f"s_{g}") for g in group], "size"), "sizes")
    # small cells of a table are worked off together, about ``together`` rows at once; large ones in blocks
    tables = sizes.groupBy("s_label", "s_dim", "s_table").agg(F.ceil(F.sum("size") / c.together).alias("parts"))
    tables = scratch.table(tables.select(*[F.col(f"s_{g}").alias(f"t_{g}") for g in group[:3]], "parts"), "tables")
    chunks = F.ceil(F.col("size") / c.block).cast("int")
    slim = wide.join(sizes, (F.col("label") == F.col("s_label")) & (F.col("dim") == F.col("s_dim")) & (F.col("table") == F.col("s_table")) & (F.col("cell") == F.col("s_cell")))
    slim = slim.join(tables, (F.col("label") == F.col("t_label")) & (F.col("dim") == F.col("t_dim")) & (F.col("table") == F.col("t_table")))
    part = F.when(F.col("size") <= c.block, F.pmod(F.xxhash64("cell"), F.col("parts"))).otherwise(F.col("cell").cast("long") + (1 << 40))
    slim = slim.withColumn("part", part)
    slim = slim.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    slim = slim.select(*group, "part", "node", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    full = own.select(F.col("node").alias("o_node"), F.col("vector"), "places", "weight")
    long = slim.join(full, F.col("node") == F.col("o_node")).drop("o_node")
    found = long.groupBy("label", "dim", "table", "part", "i", "j").applyInArrow(_block(c, kind), "node long, links long, root long")
    found = scratch.table(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    names = own.select(F.col("node").alias("o_node"), "c_node", F.col("label").alias("o_label"), F.col("dim").alias("o_dim"), F.col("f1").alias("o_f1"), F.col("f2").alias("o_f2"))
    counts = counts.join(names, F.col("node") == F.col("o_node")).select("o_label", "o_dim", "o_f1", "o_f2", "links")
    counts = scratch.table(counts, "counts")
    of_a, of_b = (own.select(F.col("node").alias(f"{n}_node"), F.col("c_node").alias(n)) for n in ("a", "b"))
    stars = found.where("node != root").join(of_a, F.col("node") == F.col("a_node")).join(of_b, F.col("root") == F.col("b_node")).select("a", "b")
    # each row with its class; then links between classes, and rows with their class's least id
    member = placed.select("id", "label", "dim", "f1", "f2").join(classes, same).select("id", "label", "dim", "f1", "f2", "c_node", "weight")
    linked = (F.col("label") == F.col("o_label")) & (F.col("dim") == F.col("o_dim")) & (F.col("f1") == F.col("o_f1")) & (F.col("f2") == F.col("o_f2"))
    member = member.join(counts, linked, "left").select("id", "c_node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    member = scratch.table(member, "member")
    edges = stars.unionByName(member.where("id != c_node").select(F.col("id").alias("a"), F.col("c_node").alias("b")))
    roots = scratch.table(connect(edges, scratch), "roots")
    alone = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(_links(F.col("v")), F.lit(False))
    out = member.select("id", "links").unionByName(alone.where(~ok).select("id", F.lit(0).cast("long").alias("links")))
    out = out.join(roots, F.col("id") == F.col("node"), "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _links(v: Column) -> Column:
    """Whether a vector can link, as :func:`usable` has it."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
