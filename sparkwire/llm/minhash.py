"""Near-duplicate documents by HyperMinHash.

A document is the set of hashes of its distinct k-word shingles. The set's sketch has 256 buckets
(by the hash's upper bits); a bucket keeps its least hash as a count of leading zeros and ten
mantissa bits, 16 bits in all, or nothing if no hash fell in it.

* Documents with equal sets are one class; from then on only a class's least document counts.
* Bands of consecutive registers are hashed; documents that share a band are candidates. How many
  bands a document has follows from its size: up to about 230 shingles they outnumber the elements in which
  two linked sets can differ, so that a link is lost only if all it shares falls into the bands of these
  elements; small sets are cut in several ways against that. Beyond that a link has to miss every
  band. Either has a chance under 1e-5, and mostly under 1e-8. Documents near a size class's border take
  part in both.
* In a band's bucket every member is a candidate with the least and the greatest member. Candidates are
  screened by the Jaccard estimate from their registers, corrected for chance collisions,
  five deviations below the limit; then full sets are compared.
* Where the members of a bucket are still in several components, those outside its largest one are
  compared with all others in blocks. A pair is screened in the first band that it shares, and
  none is written out but those that pass; their full sets are compared as well.

No bucket or group is capped. A bucket that holds a large part of all rows is only ever met by
partial aggregation, by joins that adaptive execution splits, or in blocks of bounded size.

Cases: a text that is null or without words has the empty set and is linked with nothing; a text with fewer
words than a shingle is one shingle; rows with the same id are one document, linked by what either holds; an empty
table gives an empty one; only the id and the text are read, other columns stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwire.llm.components import connect
from sparkwire.llm.scratch import Scratch
from sparkwire.llm.wordhash import U, distinct, mix, slices

BUCKETS, MANTISSA = 256, 10
_BAND = (1 << 15) - 1


@dataclass(frozen=True)
class Near:
    shingle: int = 5
    similar: int = 80  # percent
    deviations: float = 5.0
    block: int = 1024  # members of a bucket that are compared with as many others at once
    short: int = 512  # sets up to this size are compared in full inside a block

    @property
    def width(self) -> int:
        """Registers to a band of a large set; 42 bands of six miss a link at 80 percent with a chance of 3e-6, at 85 of 3e-9."""
        return 6 if self.similar >= 80 else 4

    def classes(self) -> list[tuple[int, int, int]]:
        """(least size, most size, bands) of each size class; the most size includes a link's reach upwards."""
        reach, out, low = 100 / self.similar, [], 2
        most_bands = BUCKETS // self.width
        while True:
            high = max(low + 1, int(low * 1.25))
            bands = int((reach - 1) * high * reach) + 1
            if bands >= most_bands:
                return [*out, (low, 1 << 60, most_bands)]
            out.append((low, int(high * reach) + 1, max(2, bands)))
            low = high


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 256 registers for each sorted set; 0 is an empty bucket."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.uint16)
    if not len(hashes):
        return out
    doc = np.repeat(np.arange(n), np.diff(offsets))
    bucket = (hashes >> U(56)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    v = hashes[first] & U((1 << 56) - 1)
    upper = v >> U(8)  # 48 bits, exact as a float
    bits = np.where(upper > 0, np.frexp(upper.astype(np.float64))[1] + 8, np.frexp((v & U(255)).astype(np.float64))[1])
    zeros = (56 - bits).astype(np.uint64)
    mantissa = ((v << zeros) >> U(55 - MANTISSA)) & U((1 << MANTISSA) - 1)
    out[doc[first], bucket[first]] = ((np.minimum(zeros, U(62)) << U(MANTISSA)) | mantissa) + U(1)
    return out


@cache
def groupings(near: Near) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, order of the registers, first register of each band) of every way in which bands are cut.

    In few bands all elements may fall into one, so small classes cut them several times over other orders.
    """
    rng, out = np.random.default_rng(97), []
    orders = [np.arange(BUCKETS), *(rng.permutation(BUCKETS) for _ in range(5))]
    for low, high, bands in near.classes():
        edges = np.linspace(0, BUCKETS, bands + 1).astype(int)[:-1]
        out += [(low, high, order, edges) for order in orders[: 6 if bands <= 3 else 3 if bands <= 6 else 1]]
    return out


def band_keys(regs: np.ndarray, sizes: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, band) of every band with a register in use; bands are numbered over all groupings."""
    rows, keys, numbers = [], [], []
    salt = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    coded = mix(regs.astype(np.uint64) * U(0xD1342543DE82EF95) + salt[None, :])
    coded[regs == 0] = 0
    for g, (low, high, order, edges) in enumerate(groupings(near)):
        has = np.flatnonzero((sizes >= low) & (sizes <= high))
        if not len(has):
            continue
        sums = np.add.reduceat(coded[has][:, order], edges, axis=1)
        used = np.add.reduceat(regs[has][:, order] > 0, edges, axis=1) > 0
        r, b = np.nonzero(used)
        rows.append(has[r])
        numbers.append(b + BUCKETS * g)
        # the lower bits of a key are its band's number
        keys.append(mix(sums[r, b]) & ~U(_BAND) | numbers[-1].astype(np.uint64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(numbers)


def shared_before(band: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, near: Near) -> np.ndarray:
    """Whether each pair shares a band with a lower number."""
    out = np.zeros(len(b), bool)
    same, used = a == b, (a > 0) | (b > 0)
    last = band // BUCKETS
    for g, (low, high, order, edges) in enumerate(groupings(near)[: last + 1]):
        both = (np.minimum(na, nb) >= low) & (np.maximum(na, nb) <= high)
        if both.any():
            hit = np.logical_and.reduceat(same[both][:, order], edges, axis=1) & np.logical_or.reduceat(used[both][:, order], edges, axis=1)
            out[both] |= (hit[:, : band % BUCKETS] if g == last else hit).any(axis=1)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for chance collisions, and the buckets that tell of them."""
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    ratio = 4.0 * na * nb / np.maximum((na + nb).astype(np.float64) ** 2, 1)
    chance = 0.169919487159739094 * ratio * 2.0**-MANTISSA  # of a bucket; the constant is HyperMinHash's
    used = np.maximum(used, 1)
    return np.clip((same / used - chance) / (1 - chance), 0, 1), used


def passes(est: np.ndarray, used: np.ndarray, na: np.ndarray, nb: np.ndarray, near: Near) -> np.ndarray:
    """Whether an estimate reaches the limit within the deviations of a sample without replacement."""
    t = near.similar / 100
    union = np.maximum((na + nb) / (1 + t), used + 1)
    return est >= t - near.deviations * np.sqrt(t * (1 - t) / used * (union - used + 1) / union) - 1e-9


def _binary_rows(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    w = flat.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * w).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]
    ).cast(pa.binary())


def _regs_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _sketches(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in slices(b.column(1), lower=True):
                docs, h = t.shingles(near.shingle)
                h, off = distinct(docs, h, hi - lo)
                n = np.diff(off)
                sums = []
                for seed in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(h ^ U(seed)), out=total[1:])
                    sums.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
                regs = registers(h, off)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(sums[0]), pa.array(sums[1]),
                     _binary_rows(regs.reshape(-1), np.arange(hi - lo + 1) * BUCKETS)],
                    names=["id", "n", "f1", "f2", "regs"],
                )

    return run


def _bands(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                c = b.slice(at, 2048)
                rows, keys, _ = band_keys(_regs_of(c.column(2)), c.column(1).to_numpy(), near)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), c.column(0).take(pa.array(rows))], names=["key", "id"])

    return run


def _screen(near: Near):
    """(a, b, na, nb, ra, rb) -> the pairs (a, b) whose estimate passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                c = batch.slice(at, 4096)
                na, nb = c.column(2).to_numpy(), c.column(3).to_numpy()
                est, used = estimate(_regs_of(c.column(4)), _regs_of(c.column(5)), na, nb)
                yield c.select([0, 1]).filter(pa.array(passes(est, used, na, nb, near)))

    return run


def _compare(near: Near):
    """(a, b, sa, sb) with sorted sets -> the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * 100 < near.similar * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= near.similar * (len(x) + len(y) - common)
            yield b.select([0, 1]).filter(pa.array(ok))

    return run


def _sets(near: Near, short: bool = False):
    """Sorted sets; short ones hold the lower 32 bits of each hash, which may only add to what two sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in slices(b.column(1), lower=True):
                docs, h = t.shingles(near.shingle)
                h, off = distinct(docs, h, hi - lo)
                kept = _binary_rows(h.astype(np.uint32) if short else h, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), kept], names=["s_id", "set"])

    return run


def _blocks(near: Near):
    """A block of a bucket: pairs of its askers with its others that lie in two components and pass the screen."""

    def run(table: pa.Table) -> pa.Table:
        regs, n = _regs_of(table["regs"].combine_chunks()), table["n"].to_numpy()
        ids, roots, asks, small = (table[c].to_numpy() for c in ("id", "root", "asks", "small"))
        # a bucket that is one block has each member once, and its askers are among the others
        whole = table["whole"][0].as_py()
        band, others = table["key"][0].as_py() & _BAND, np.arange(len(ids)) if whole else np.flatnonzero(~asks)
        sets = [None if x is None else np.frombuffer(x, np.uint32) for x in table["set"].to_pylist()]
        out_a, out_b = [], []
        for x in np.flatnonzero(asks):
            # two askers meet twice: the lower one asks
            y = others[(roots[others] != roots[x]) & (~small[others] | (ids[others] > ids[x]))]
            if len(y):
                est, used = estimate(regs[x][None, :], regs[y], n[x], n[y])
                y = y[passes(est, used, n[x], n[y], near)]
            if len(y):
                y = y[~shared_before(band, regs[x][None, :], regs[y], n[x], n[y], near)]
            if len(y) and sets[x] is not None:
                # short sets are compared as they are
                full = np.array([sets[i] is not None for i in y])
                y, z = y[~full], y[full]
                if len(z):
                    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in z])])[:-1]
                    common = np.add.reduceat(np.isin(np.concatenate([sets[i] for i in z]), sets[x]).astype(np.int64), starts)
                    y = np.concatenate([y, z[100 * common >= near.similar * (n[x] + n[z] - common)]])
            if len(y):
                out_a.append(np.full(len(y), ids[x]))
                out_b.append(ids[y])
        a, b = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_a, out_b))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


class NearDuplicates:
    """The steps of one call; ``result()`` has a row per document."""

    def __init__(self, docs: DataFrame, scratch: Scratch, near: Near, id_col: str, text_col: str):
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.scratch, self.near = scratch, near

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar."""
        sc, near = self.scratch, self.near
        wanted = sc.table(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct(), "wanted")
        texts = self.docs.join(wanted, F.col("id") == F.col("w"), "left_semi")
        sets = sc.table(texts.mapInArrow(_sets(near), "s_id long, set binary"), "sets")
        one = pairs.join(sets.select(F.col("s_id").alias("ia"), F.col("set").alias("sa")), F.col("a") == F.col("ia")).drop("ia")
        two = one.join(sets.select(F.col("s_id").alias("ib"), F.col("set").alias("sb")), F.col("b") == F.col("ib")).drop("ib")
        links = sc.table(two.select("a", "b", "sa", "sb").mapInArrow(_compare(near), "a long, b long").distinct(), "links")
        sc.drop(wanted, sets)
        return links

    def classes(self) -> DataFrame:
        """id, n and rep of every row, rep being the least id with the same set; and the sketches of the reps."""
        sc = self.scratch
        sketch = self.docs.mapInArrow(_sketches(self.near), "id long, n long, f1 long, f2 long, regs binary")
        sketch = sc.table(sketch, "sketches")
        reps = sketch.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
        reps = sc.table(reps.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("gn"), "rep"), "classes")
        same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("gn"))
        rows = sketch.select("id", "n", "f1", "f2").join(reps, same, "left")
        self.rows = sc.table(rows.select("id", "n", F.coalesce("rep", "id").alias("rep")), "rows")
        own = sketch.join(reps.select(F.col("rep").alias("own"), "g1", "g2"), (F.col("id") == F.col("own")) & (F.col("f1") == F.col("g1")), "left_semi")
        # equal rows of one id; by the keys of the join, so that the registers are shuffled once
        self.sketch = sc.table(own.dropDuplicates(["id", "f1"]).select("id", "n", "regs"), "reps")
        sc.drop(sketch, reps)
        return self.rows

    def buckets(self) -> DataFrame:
        """key, id, lead (least id) and last (greatest) of every bucket with two members or more."""
        bands = self.sketch.mapInArrow(_bands(self.near), "key long, id long")
        bands = self.scratch.table(bands, "bands")
        full = bands.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
        full = self.scratch.table(full.select(F.col("key").alias("k"), "lead", "last"), "buckets")
        out = self.scratch.table(bands.join(full, F.col("key") == F.col("k")).drop("k"), "members")
        self.scratch.drop(bands, full)
        return out

    def screened(self, pairs: DataFrame) -> DataFrame:
        one = pairs.join(self.sketch.select(F.col("id").alias("ia"), F.col("n").alias("na"), F.col("regs").alias("ra")), F.col("a") == F.col("ia"))
        two = one.join(self.sketch.select(F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("regs").alias("rb")), F.col("b") == F.col("ib"))
        out = two.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_screen(self.near), "a long, b long")
        return self.scratch.table(out, "screened")

    def across(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs across components in buckets that hold several: the members outside the bucket's largest
        component ask, in blocks, all others."""
        sc, block = self.scratch, self.near.block
        m = members.join(roots.select("node", "root"), F.col("id") == F.col("node"), "left")
        m = sc.table(m.select("key", "id", "lead", "last", F.coalesce("root", "id").alias("root")), "rooted")
        parts = m.groupBy("key", "root").agg(F.count("*").alias("n"))
        several = parts.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top"))
        # the least and the greatest member have been compared with all others
        several = several.where("size > top.n and size > 3")
        several = several.select(F.col("key").alias("k"), "size", (F.col("size") - F.col("top.n")).alias("rest"), F.col("top.root").alias("top"))
        several = sc.table(several, "several")
        m = m.join(several, F.col("key") == F.col("k")).where("id != lead and id != last")
        n_asks, n_others = (F.ceil(F.col(c) / block).cast("int") for c in ("rest", "size"))
        place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        m = m.withColumn("small", F.col("root") != F.col("top")).withColumn("whole", F.col("size") <= 2 * block)
        blocks = F.when(F.col("whole"), 1).otherwise(n_asks)
        others = m.withColumn("asks", F.col("whole") & F.col("small")).withColumn("j", F.when(F.col("whole"), 0).otherwise(place(n_others)))
        others = others.withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
        askers = m.where("small and not whole").withColumn("asks", F.lit(True)).withColumn("i", place(n_asks))
        askers = askers.withColumn("j", F.explode(F.sequence(F.lit(0), n_others - 1)))
        columns = ["key", "id", "root", "small", "asks", "whole", "i", "j"]
        m = sc.table(others.select(columns).unionByName(askers.select(columns)), "askers")
        short = m.select("id").distinct().join(self.sketch.where(F.col("n") <= self.near.short).select(F.col("id").alias("w")), F.col("id") == F.col("w"), "left_semi")
        short = sc.table(short.select(F.col("id").alias("w")), "short")
        texts = self.docs.join(short, F.col("id") == F.col("w"), "left_semi")
        short = sc.table(texts.mapInArrow(_sets(self.near, short=True), "s_id long, set binary"), "short-sets")
        known = self.sketch.join(short, F.col("id") == F.col("s_id"), "left").select(F.col("id").alias("k_id"), "n", "regs", "set")
        m = m.join(known, F.col("id") == F.col("k_id")).drop("k_id")
        return sc.table(m.groupBy("key", "i", "j").applyInArrow(_blocks(self.near), "a long, b long").distinct(), "across")

    def result(self) -> DataFrame:
        sc = self.scratch
        rows = self.classes()
        members = self.buckets()
        least = members.where("id > lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))
        stars = least.unionByName(members.where("id < last").select(F.col("last").alias("a"), F.col("id").alias("b"))).distinct()
        links = self.linked(self.screened(stars))
        roots = sc.table(connect(links, sc), "roots")
        rest = self.across(members, roots)
        more = self.linked(rest)
        # the components found so far are stars already, which the new links join in few rounds
        known = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = sc.table(connect(known.unionByName(more), sc), "roots")
        out = rows.join(roots, F.col("rep") == F.col("node"), "left")
        component = F.coalesce("root", "rep")
        return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, scratch: Scratch, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id_col, n_shingles, component_id, kept (one of each component)."""
    return NearDuplicates(docs, scratch, near, id_col, text_col).result().withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, scratch: Scratch, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, whatever their names, one document of each component: the one with the least id.

    Rows that repeat an id are one document, of which one row stays. A row without an id can't be told
    from others and stays.
    """
    verdicts = near_duplicates(docs, scratch, near, id_col, text_col)
    verdicts = scratch.table(verdicts.select(F.col(id_col).alias("v_id"), "kept"), "verdicts")
    gone = verdicts.where(~F.col("kept")).select("v_id")
    again = verdicts.where(F.col("kept") & F.col("v_id").isNotNull()).groupBy("v_id").agg(F.count("*").alias("n")).where("n > 1").select("v_id")
    again = scratch.table(again, "again")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("k_id"))
    # the ids that go grow with the documents, so they are never broadcast: one shuffle of the texts at every size
    out = rows.join(gone.unionByName(again).hint("merge"), F.col("k_id") == F.col("v_id"), "left_anti")
    twice = rows.join(again, F.col("k_id") == F.col("v_id"), "left_semi").groupBy("k_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.select("row.*").unionByName(twice.select("row.*"))
