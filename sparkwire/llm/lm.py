"""Language-model scoring with an Elias-Fano n-gram trie.

Counting. Each task hashes the words of its texts and counts unigrams and bigrams of a batch in
sorted arrays; these are cut by the upper bits of the context word's hash into as many buckets as
there are shuffle partitions, or one for each 64 MB of text if these are more (the next power of two), merged bucket by bucket, and written
as the trie's shards. Every word
that occurs is kept; bigrams are kept from ``least`` occurrences on, and the weight of the others goes to the back-off.

Model. Absolute discounting: P(w | c) = (n(c, w) - D) / n(c) + back(c) P(w), where back(c) is all weight
that kept bigrams leave; P(w) = (n(w) - D) / N, and all unknown words together have D V / N. A text
stands between two end marks, which are words of the model.

Trie. Level 1 holds the words' hashes as one Elias-Fano sequence, with counts; level 2 holds, for each
context, the indices of its successors. Successors are coded relative to their context, as context * V + word,
in one Elias-Fano sequence of the shard; pointers, monotone and Elias-Fano coded as well, give each
context's range, in which a word is found by successor search. Probabilities and back-off weights are
quantised to 16 bits of log10 (steps of 1 / 4096). Scoring tasks map the levels into memory.

Cases: a null or wordless text is the end mark alone; texts are read whole; equal rows count each time; a null id
trains; an empty training set gives every word the probability 1 of the unknown; other columns are not read.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire.llm.eliasfano import EliasFano, encode
from sparkwire.llm.scratch import Scratch
from sparkwire.llm.wordhash import slices

U = np.uint64
END = U(0x6A09E667F3BCC908)
STEP = 4096.0
_HELD = 4_000_000  # bigram counts that a counting task holds before it sends them off, 24 bytes each


@dataclass(frozen=True)
class Shape:
    shards: int
    discount: float = 0.6
    least: int = 2


def _pair_counts(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (a, b) summed up, sorted by both."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    return a[at], b[at], np.add.reduceat(n, at) if len(at) else n


def _counts(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(a, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)).astype(np.int64) if len(u) else np.zeros(0, np.int64)


def sequence(t) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each text closed by an end mark; and where each text starts, with an end."""
    n = t.n_words + 1
    starts = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(starts[-1], np.uint64)
    out[starts[1:] - 1] = END
    doc = np.repeat(np.arange(len(n)), t.n_words)
    out[np.arange(len(t.starts)) + doc] = t.words()
    return out, starts


def _count_batches(shape: Shape):
    bits = max(1, (shape.shards - 1).bit_length())

    def rows(uni: list, bi: list) -> Iterator[dict]:
        w, n = _counts(np.concatenate([u for u, _ in uni]), np.concatenate([c for _, c in uni]))
        a, b, m = _pair_counts(*(np.concatenate(x) for x in zip(*bi, strict=True)))
        cut_w = np.searchsorted((w >> U(64 - bits)).astype(np.int64), np.arange(shape.shards + 1))
        cut_a = np.searchsorted((a >> U(64 - bits)).astype(np.int64), np.arange(shape.shards + 1))
        for s in range(shape.shards):
            x, y = slice(cut_w[s], cut_w[s + 1]), slice(cut_a[s], cut_a[s + 1])
            if x.stop > x.start:
                ctx, reps = np.unique(a[y], return_counts=True)
                small = m[y].astype(np.uint16) if len(m[y]) and m[y].max() < 65536 else m[y].astype(np.uint64)
                yield s, w[x], n[x].astype(np.uint32) if n[x].max() < 1 << 32 else n[x], ctx, reps.astype(np.uint32), b[y], small

    def batches_of(uni: list, bi: list) -> Iterator[pa.RecordBatch]:
        for s, *arrays in rows(uni, bi):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_pack(arrays)], pa.binary())], names=["shard", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, bi, held = [], [], 0
        for batch in batches:
            for _, _, t in slices(batch.column(0), lower=True, most_bytes=1 << 21):
                words, starts = sequence(t)
                before = np.empty_like(words)
                before[1:] = words[:-1]
                before[starts[:-1]] = END
                uni.append(np.unique(words, return_counts=True))
                bi.append(_pair_counts(before, words, np.ones(len(words), np.int64)))
                held += len(bi[-1][0])
                if held > _HELD:
                    yield from batches_of(uni, bi)
                    uni, bi, held = [], [], 0
        if uni:
            yield from batches_of(uni, bi)

    return run


def _pack(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return out.getvalue()


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    f = io.BytesIO(data)
    return [np.load(f, allow_pickle=False) for _ in range(n)]


def _store(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write under a name of this attempt and rename: a repeated task replaces equal bytes."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{os.getpid()}-{np.random.default_rng().integers(1 << 60):x}"
    with fs.open_output_stream(own) as f:
        for name, a in arrays.items():
            a = np.ascontiguousarray(a)
            head = np.zeros(8, np.int64)
            head[:3] = [int.from_bytes(name.encode()[:8].ljust(8, b"\0"), "little"), int.from_bytes(a.dtype.str.encode()[:8].ljust(8, b"\0"), "little"), a.nbytes]
            f.write(head.tobytes())
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 64))
    fs.move(own, path)


def _mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a stored file, mapped into memory; a file that is not local is copied first."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(path, np.uint8, "r")
    else:
        held = tempfile.TemporaryFile()
        with fs.open_input_stream(path) as f:
            while block := f.read(1 << 22):
                held.write(block)
        held.flush()
        whole = np.memmap(held, np.uint8, "r")
    out, at = {}, 0
    word = lambda x: int(x).to_bytes(8, "little").rstrip(b"\0").decode()
    while at < len(whole):
        name, kind, size = whole[at : at + 24].view(np.int64)
        out[word(name)] = np.asarray(whole[at + 64 : at + 64 + int(size)]).view(word(kind))
        at += 64 + (int(size) + 63) // 64 * 64
    return out


def _coded(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {prefix + k: v for k, v in arrays.items()}


def _decoded(prefix: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano({k: arrays[prefix + k] for k in ("meta", "upper", "ones", "lower")})


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in as few bytes as hold them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(np.round(-np.log10(np.maximum(p, 1e-300)) * STEP), 65534).astype(np.uint16)


def _merge(folder: str, shape: Shape):
    """One shard's counts: its words are stored; its bigrams wait for the words of all shards."""

    def run(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        parts = [_unpack(c.as_buffer().to_pybytes(), 6) for c in table["counts"]]
        w, n = _counts(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        a = np.concatenate([np.repeat(p[2], p[3]) for p in parts])
        a, b, m = _pair_counts(a, np.concatenate([p[4] for p in parts]), np.concatenate([p[5].astype(np.int64) for p in parts]))
        seen_a, seen_n = _counts(a, m)  # how often each word is a context
        context = np.zeros(len(w), np.int64)
        context[np.searchsorted(w, seen_a)] = seen_n
        kept = m >= shape.least
        bits = max(1, (shape.shards - 1).bit_length())
        inside = w & (U(0xFFFFFFFFFFFFFFFF) >> U(bits))
        _store(f"{folder}/words-{s:05d}", {**_coded("w", encode(inside, 1 << (64 - bits))), "n": n})
        _store(f"{folder}/pairs-{s:05d}", {"a": _narrow(np.searchsorted(w, a[kept])), "b": b[kept], "m": _narrow(m[kept]), "c": _narrow(context)})
        return pa.table({"shard": pa.array([s], pa.int32()), "words": pa.array([len(w)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    return run


class Words:
    """Level 1 of all shards."""

    def __init__(self, folder: str, shape: Shape, sizes: tuple[int, ...]):
        self.bits = max(1, (shape.shards - 1).bit_length())
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.parts = [_mapped(f"{folder}/words-{s:05d}") if size else None for s, size in enumerate(sizes)]
        self.hashes = [_decoded("w", p) if p else None for p in self.parts]

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index or -1, count) of sorted different hashes."""
        index, count = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        cut = np.searchsorted((words >> U(64 - self.bits)).astype(np.int64), np.arange(len(self.parts) + 1))
        for s, p in enumerate(self.parts):
            if p is not None and cut[s] < cut[s + 1]:
                x = slice(cut[s], cut[s + 1])
                i = self.hashes[s].find(words[x] & (U(0xFFFFFFFFFFFFFFFF) >> U(self.bits)))
                count[x] = np.where(i >= 0, p["n"][np.maximum(i, 0)], 0)
                index[x] = np.where(i >= 0, i + self.base[s], -1)
        return index, count


@lru_cache(maxsize=1)
def _words(folder: str, shape: Shape, sizes: tuple[int, ...]) -> Words:
    return Words(folder, shape, sizes)


def _grow(folder: str, shape: Shape, sizes: tuple[int, ...], total: int):
    """Level 2 of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(folder, shape, sizes)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                p = _mapped(f"{folder}/pairs-{s:05d}")
                a, b, m, context = p["a"].astype(np.int64), p["b"], p["m"].astype(np.int64), p["c"].astype(np.int64)
                different, inverse = np.unique(b, return_inverse=True)
                index, count = words.find(different)
                unigram = np.maximum(count[inverse] - shape.discount, 0) / total
                b = index[inverse]
                order = np.lexsort((b, a))
                a, b, m, unigram = a[order], b[order], m[order], unigram[order]
                v, n = int(words.base[-1]), sizes[s]
                left = context - np.bincount(a, m - shape.discount, n)
                back = np.where(context > 0, left / np.maximum(context, 1), 1.0)
                prob = (m - shape.discount) / context[a] + back[a] * unigram
                pointers = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
                keys = a.astype(np.uint64) * U(v) + b.astype(np.uint64)
                _store(
                    f"{folder}/grams-{s:05d}",
                    {**_coded("k", encode(keys, n * v + 1)), **_coded("p", encode(pointers, len(a) + 1)), "prob": _quantised(prob), "back": _quantised(back)},
                )
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(a)], pa.int64())], names=["shard", "grams"])

    return run


class Trie:
    def __init__(self, folder: str, shape: Shape, sizes: tuple[int, ...], total: int):
        self.words, self.shape, self.total = _words(folder, shape, sizes), shape, total
        self.v = int(self.words.base[-1])
        self.parts = [_mapped(f"{folder}/grams-{s:05d}") if size else None for s, size in enumerate(sizes)]
        self.keys = [_decoded("k", p) if p else None for p in self.parts]
        self.pointers = [_decoded("p", p) if p else None for p in self.parts]

    def scores(self, t) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        words, starts = sequence(t)
        different, inverse = np.unique(words, return_inverse=True)
        index, count = self.words.find(different)
        d, total = self.shape.discount, max(self.total, 1)
        unknown = d * self.v / total if self.v else 1.0
        unigram = np.log10(np.where(count > 0, np.maximum(count - d, 1e-9) / total, unknown))
        base = np.log10((count + 1) / (self.total + self.v + 1))
        end = int(np.searchsorted(different, END))
        # what each different word is as a context: its range of successors and its back-off
        lo, hi, back = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64), np.zeros(len(different))
        shard = np.searchsorted(self.words.base, index, "right") - 1
        shard[index < 0] = -1
        for s in np.unique(shard[shard >= 0]):
            has = np.flatnonzero(shard == s)
            i = index[has] - self.words.base[s]
            lo[has], hi[has] = self.pointers[s].access(i), self.pointers[s].access(i + 1)
            back[has] = self.parts[s]["back"][i] / -STEP
        before = np.empty_like(inverse)
        before[1:] = inverse[:-1]
        before[starts[:-1]] = end
        pair = before * np.int64(len(different)) + inverse
        pairs, which = np.unique(pair, return_inverse=True)
        c, w = pairs // len(different), pairs % len(different)
        logs = back[c] + unigram[w]
        may = (hi[c] > lo[c]) & (count[w] >= self.shape.least)
        for s in np.unique(shard[c[may]]) if may.any() else ():
            q = np.flatnonzero(may & (shard[c] == s))
            key = (index[c[q]] - self.words.base[s]).astype(np.uint64) * U(self.v) + index[w[q]].astype(np.uint64)
            i = self.keys[s].find(key, lo[c[q]], hi[c[q]])
            hit = i >= 0
            logs[q[hit]] = self.parts[s]["prob"][i[hit]] / -STEP
        n = np.diff(starts)
        sums = lambda x: np.add.reduceat(x, starts[:-1]) if len(n) else np.zeros(0)
        return n, sums((count > 0)[inverse].astype(np.int64)), sums(base[inverse]), sums(logs[which])


@lru_cache(maxsize=1)
def _trie(folder: str, shape: Shape, sizes: tuple[int, ...], total: int) -> Trie:
    return Trie(folder, shape, sizes, total)


@dataclass(frozen=True)
class Model:
    """What a scoring task needs to open the trie: a word count per shard, and no more of the corpus."""

    folder: str
    shape: Shape
    sizes: tuple[int, ...]
    total: int


def train(
    texts: DataFrame, scratch: Scratch, discount: float = 0.6, least: int = 2, shard_bytes: int = 1 << 26, text_col: str = "text"
) -> Model:
    spark = texts.sparkSession
    # so many that the counts of a shard, which one task merges, do not grow with the corpus
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // shard_bytes)
    # a power of two, as shards are cut by the upper bits of a hash
    shards = 1 << max(1, (wanted - 1).bit_length())
    shape, folder = Shape(shards, discount, least), scratch.place("trie")
    counts = texts.select(F.col(text_col).alias("t")).mapInArrow(_count_batches(shape), "shard int, counts binary")
    merged = counts.groupBy("shard").applyInArrow(_merge(folder, shape), "shard int, words long, tokens long")
    found = {r["shard"]: (r["words"], r["tokens"]) for r in scratch.table(merged, "shards").collect()}  # a row per shard
    sizes = tuple(found.get(s, (0, 0))[0] for s in range(shards))
    total = sum(n for _, n in found.values())
    todo = spark.range(shards).select(F.col("id").cast("int").alias("shard")).where(F.col("shard").isin([s for s, n in enumerate(sizes) if n] or [-1]))
    todo.repartition(shards, "shard").mapInArrow(_grow(folder, shape, sizes, total), "shard int, grams long").write.format("noop").mode("overwrite").save()
    return Model(folder, shape, sizes, total)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model.folder, model.shape, model.sizes, model.total)
        for b in batches:
            for lo, hi, t in slices(b.column(2), lower=True, most_bytes=1 << 22):
                n, known, base, got = trie.scores(t)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n), pa.array(known),
                     pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(got)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
