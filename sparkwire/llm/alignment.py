"""Cross-tokenizer alignment: how the tokens of two public tokenizers cover the same bytes.

Texts are cut before runs of white space, at places where neither vocabulary can merge across (:func:`cutter` checks
that on the files themselves). Different segments are few against all segments, so the work is done once for each:

1. a task numbers the segments of a block of documents and keeps the documents as segment numbers;
2. each block's different segments are shuffled by segment; equal ones meet, are encoded by both libraries and aligned
   once, and go back to their blocks;
3. a block composes its documents from alignments and counts, once a document, which id pairs it holds linked;
4. the counts are summed up over all blocks and go back to the blocks that hold the pair.

A block is about ``BLOCK`` bytes of text (one longer text is a block of its own), so no task grows with the corpus, and a
segment has one row in each block, however often it stands in the texts.

Defined results: a text that is null or empty, or of which one tokenizer does not give the bytes back, has no tokens: zeros and
an empty digest. Rows of one id, or of none, are documents of their own. An empty table gives an empty table. Only ``doc_id``
and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch
from sparkwire.llm.tokenids import cut_of

BLOCK = 1 << 24
_STEP = 1 << 15
_MANY_LINKS = 4096  # of one group; with more, equal pairs are summed up before they are written out
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Two tokenizers: a byte-level one of the tokenizers library (A) and a sentencepiece model (B)."""

    def __init__(self, a: str, b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = pieces.index("▁") if "▁" in pieces else -1
        # the byte-level alphabet: 188 bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        level = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(plain))}
        assert set(level) == set(ByteLevel.alphabet())
        self.a_bytes = {i: bytes(level[c] for c in t) if all(c in level for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.pattern = cutter(cut_of(a) == "kept", pieces)

    def segments(self, text: str) -> list[str]:
        """The segments of a space and the text; joined they give it back."""
        whole = " " + text
        return self.pattern.findall(whole) if self.pattern else [whole]

    def align(self, segments: list[str]) -> list[str | None]:
        """``a1,a2|b1;a3|b2,b3`` of each segment, None where one side's bytes differ from the segment's."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # B puts a blank before what it gets: it stands for the first space, and is taken off before anything else
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments])
        out = []
        for s, x, y in zip(segments, a, b, strict=True):
            if s[0] != " ":
                y = y[1:] if y and y[0] == self.blank else []  # noqa: PLW2901
            if s == " " and not y and self.blank >= 0:
                y = [self.blank]  # noqa: PLW2901 - a lone blank: the library gives an empty text no tokens
            raw = s.encode()
            xs, ys = [self.a_bytes[i] for i in x], [self.b_bytes[i] for i in y]
            out.append(_groups(x, xs, y, ys) if b"".join(xs) == raw == b"".join(ys) else None)
        return out


def _groups(x: list[int], xs: list[bytes], y: list[int], ys: list[bytes]) -> str:
    out, i, j, at_a, at_b, first_a, first_b = [], 0, 0, 0, 0, 0, 0
    while i < len(x) or j < len(y):
        if at_a <= at_b and i < len(x):
            at_a += len(xs[i])
            i += 1
        else:
            at_b += len(ys[j])
            j += 1
        if at_a == at_b:
            out.append(",".join(map(str, x[first_a:i])) + "|" + ",".join(map(str, y[first_b:j])))
            first_a, first_b = i, j
    return ";".join(out)


def cutter(a_keeps_space: bool, pieces: list[str]) -> re.Pattern | None:
    """Finds segments: a run of white space and what follows up to the next. None: texts can't be cut.

    A (byte-level) first cuts where white space follows something else. B merges inside the whole text, so a character can begin a
    segment only if no piece has it after a character other than white space. The rest (a carriage return in many vocabularies, white space beyond ASCII) stays
    inside its segment.
    """
    if not a_keeps_space:
        return None
    held = [p.replace("▁", " ") for p in pieces]
    before = lambda c: r"\S" if c == " " else r"[\S ]"  # noqa: E731 - B's own blank stands before a segment that has none
    safe = [c for c in " \n\t\v\f\r" if not any(re.search(before(c) + re.escape(c), p) for p in held)]
    if " " not in safe:
        return None
    w = "".join(map(re.escape, safe))
    return re.compile(rf"[{w}]*[^{w}]+(?:(?<=\s)[{w}]+[^{w}]*)*|[{w}]+")


@cache
def pair(a: str, b: str) -> Pair:
    """One for each worker process."""
    return Pair(a, b)


class _Numbers(dict):
    def __missing__(self, segment: str) -> int:
        n = self[segment] = len(self)
        return n


def _coded(a: str, b: str) -> Callable:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, task, done = pair(a, b), TaskContext.get().partitionId(), 0
        ids, sizes, codes, numbers, held = [], [], array("I"), _Numbers(), 0

        def block() -> pa.RecordBatch:
            row = {"block": (task << 32) + done, "ids": ids, "sizes": sizes, "codes": _pack(np.frombuffer(codes, np.uint32)), "segments": list(numbers)}
            kinds = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary(), "segments": pa.list_(pa.string())}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], list(kinds))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokenizers.segments(t) if (t := text.as_py()) else []
                ids.append(doc)
                sizes.append(len(found))
                codes.extend(map(numbers.__getitem__, found))
                held += len(t or "") + 16
                if held >= BLOCK:
                    yield block()
                    done, held = done + 1, 0
                    ids, sizes, codes, numbers = [], [], array("I"), _Numbers()
        if ids:
            yield block()

    return blocks


def _aligned(a: str, b: str) -> Callable:
    """Rows (block, no, segment) in the order of segments: equal ones stand together and are aligned once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, last, groups_of_last = pair(a, b), None, None
        for batch in batches:
            segments = batch.column("segment").to_pylist()
            new = list(dict.fromkeys(segments))
            known = {}
            if new and new[0] == last:
                known[last] = groups_of_last
                new = new[1:]
            known.update(zip(new, tokenizers.align(new), strict=True))
            if segments:
                last, groups_of_last = segments[-1], known[segments[-1]]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("no"), pa.array(map(known.__getitem__, segments), pa.string())], ["block", "no", "groups"])

    return rows


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane: the high planes are almost empty."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _sums(values: np.ndarray, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values[codes], dtype=np.int64)])
    return np.diff(total[cuts])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Groups:
    """The alignments of a block's segments, read from their text all at once."""

    def __init__(self, texts: pa.LargeStringArray):
        n = len(texts)
        bufs = texts.buffers()
        at = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(bufs[2], np.uint8)[at[0] : at[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        digit = (data >= 48) & (data <= 57)
        starts = np.flatnonzero(digit & (edge[:-1] | ~np.concatenate([[False], digit[:-1]])))
        ends = np.flatnonzero(digit & (edge[1:] | ~np.concatenate([digit[1:], [False]]))) + 1
        ids, size = np.zeros(len(starts), np.int64), ends - starts
        for j in range(int(size.max()) if len(size) else 0):
            live = size > j
            ids[live] = ids[live] * 10 + data[starts[live] + j] - 48
        has = np.diff(at) > 0
        segment = (np.searchsorted(at, starts, "right") - 1).astype(np.int32)
        group = np.cumsum(data == ord(";"), dtype=np.int32)[starts] + (np.cumsum(has) - has)[segment] if len(starts) else np.zeros(0, np.int64)
        is_b = np.cumsum(data == ord("|"), dtype=np.int32)[starts] > group if len(starts) else np.zeros(0, bool)
        n_groups = int(group[-1]) + 1 if len(group) else 0
        na, nb = (np.bincount(group[x], minlength=n_groups) for x in (~is_b, is_b))
        first = np.cumsum(na + nb) - na - nb  # a group's ids of A come first, those of B after them
        of = segment[first] if n_groups else np.zeros(0, np.int64)
        links = na * nb
        per_segment = lambda x: np.bincount(of, x, n).astype(np.int64)
        self.n_a, self.n_b, self.n_groups, self.n_links = (per_segment(x) for x in (na, nb, np.ones(n_groups), links))
        small = np.flatnonzero(links <= _MANY_LINKS)
        pairs, places, times = [], [], []
        for lo in range(0, len(small), _STEP):  # some groups at a time
            some = small[lo : lo + _STEP]
            each = np.repeat(some, links[some])
            i = _ranges(np.zeros(len(some), np.int64), links[some])
            pairs.append(ids[first[each] + i // nb[each]] << 32 | ids[first[each] + na[each] + i % nb[each]])
            places.append(of[each])
            times.append(np.ones(len(each), np.int64))
        for g in np.flatnonzero(links > _MANY_LINKS):
            (x, p), (y, q) = (np.unique(ids[lo : lo + k], return_counts=True) for lo, k in ((first[g], na[g]), (first[g] + na[g], nb[g])))
            pairs.append((x[:, None] << 32 | y).ravel())
            times.append((p[:, None] * q).ravel())
            places.append(np.full(len(x) * len(y), of[g]))
        none = np.zeros(0, np.int64)
        pair, place, self.times = (np.concatenate([none, *x]) for x in (pairs, places, times))
        del starts, ends, ids, segment, group, is_b, digit, edge, pairs, places, times
        order = np.argsort(place, kind="stable")
        self.times = self.times[order]
        #: The block's different pairs, the place of each link's pair among them, and where each segment's links begin.
        self.pairs, self.pair_of = np.unique(pair[order], return_inverse=True)
        self.ends = np.searchsorted(place[order], np.arange(n + 1))


def _compose(blocks: pa.Table, placed: pa.Table) -> pa.Table:
    """One block: its documents' numbers and digests, the id pairs that each holds linked, and how many documents hold each pair."""
    row = blocks.to_pylist()[0]
    codes, sizes = _unpack(row["codes"], np.uint32), np.array(row["sizes"], np.int64)
    order = np.argsort(placed["no"].to_numpy())
    texts = placed["groups"].combine_chunks().cast(pa.large_string()).take(pa.array(order)) if len(order) else pa.array([], pa.large_string())
    bad = texts.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    found = _Groups(texts.fill_null(""))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    good = (_sums(bad, codes, cuts) == 0) & (sizes > 0)
    raw = texts.cast(pa.large_binary()).to_pylist()
    digests = [sha256(b";".join(map(raw.__getitem__, codes[cuts[i] : cuts[i + 1]].tolist()))).hexdigest() if good[i] else "" for i in range(len(sizes))]
    sums = {k: np.where(good, _sums(getattr(found, k), codes, cuts), 0) for k in ("n_a", "n_b", "n_groups", "n_links")}
    held, times, many = _links(codes, cuts, good, found)
    docs = np.bincount(held, minlength=len(found.pairs))
    keep = np.flatnonzero(docs)
    del raw, texts, placed
    pa.default_memory_pool().release_unused()
    out = {"block": row["block"], "ids": row["ids"], "digests": digests, "held": _pack(held.astype(np.uint32)), "times": _pack(times), "many": many, "places": keep, "pairs": found.pairs[keep], "docs": docs[keep]} | sums
    return pa.Table.from_arrays([pa.array([out[f.name]], f.type) for f in _COMPOSED], schema=_COMPOSED)


def _links(codes: np.ndarray, cuts: np.ndarray, good: np.ndarray, found: _Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, times) of the different links of each document, one document after the other, and how many each has; some documents at a time."""
    helds, weights, many_of, first, n_docs, ends = [], [], [], 0, len(good), found.ends
    while first < n_docs:
        last = min(max(first + 1, int(np.searchsorted(cuts, cuts[first] + (1 << 17), "right")) - 1), n_docs)
        doc = np.repeat(np.arange(last - first), np.diff(cuts[first : last + 1]))
        ok = good[first:last][doc]
        both, again = np.unique(doc[ok] << 32 | codes[cuts[first] : cuts[last]][ok], return_counts=True)
        d, c = both >> 32, both & 0xFFFFFFFF
        many = ends[c + 1] - ends[c]
        link = _ranges(ends[c], many)
        held, at = np.unique(np.repeat(d, many) << 32 | found.pair_of[link], return_inverse=True)
        helds.append(held & 0xFFFFFFFF)
        weights.append(np.bincount(at, np.repeat(again, many) * found.times[link], len(held)).astype(np.uint64))
        many_of.append(np.bincount(held >> 32, minlength=last - first))
        first = last
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return join(helds, np.int64), join(weights, np.uint64), join(many_of, np.int64)


_LONGS = pa.list_(pa.int64())
_COMPOSED = pa.schema([
    ("block", pa.int64()), ("ids", _LONGS), ("digests", pa.list_(pa.string())), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS),
    ("held", pa.binary()), ("times", pa.binary()), ("many", _LONGS), ("places", pa.list_(pa.int32())), ("pairs", _LONGS), ("docs", _LONGS),
])
_COMPOSED_SQL = (
    "block long, ids array<long>, digests array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "held binary, times binary, many array<long>, places array<int>, pairs array<long>, docs array<long>"
)


def _finish(blocks: pa.Table, counted: pa.Table) -> pa.Table:
    """One block's documents with the corpus-wide counts of their links."""
    row = blocks.to_pylist()[0]
    held, times = _unpack(row["held"], np.uint32), _unpack(row["times"], np.uint64).astype(np.int64)
    count, best = np.zeros((2, int(held.max()) + 1 if len(held) else 0), np.int64)
    place = counted["place"].to_numpy()
    count[place], best[place] = counted["n"].to_numpy(), counted["best"].to_numpy()
    cuts = np.concatenate([[0], np.cumsum(row["many"], dtype=np.int64)])
    n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(v[held] * times)])[cuts]) for v in (best, count))
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), **{k: pa.array(row[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": n_best, "count_sum": count_sum, "groups_sha256": pa.array(row["digests"], pa.string())})


def composed(docs: DataFrame, scratch: Scratch, a: str, b: str) -> DataFrame:
    """A row for each block: its documents as segment numbers, their token and group counts and digests, and the block's id pairs."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = scratch.table(d.mapInArrow(_coded(a, b), "block long, ids array<long>, sizes array<int>, codes binary, segments array<string>"), "coded")
    each = coded.select("block", F.posexplode("segments").alias("no", "segment"))
    placed = each.repartition("segment").sortWithinPartitions("segment").mapInArrow(_aligned(a, b), "block long, no int, groups string")
    out = coded.drop("segments").groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_compose, _COMPOSED_SQL)
    out = scratch.table(out, "composed")
    scratch.drop(coded)
    return out


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no other pair of its A id has more."""
    n = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    most = n.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    n = n.withColumn("a", F.shiftright("pair", 32)).join(most, "a")
    return n.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, scratch: Scratch, a: str, b: str) -> DataFrame:
    """Of each document: tokens of both, groups, links, links that are the best of their A id, the sum of the links' counts, and the digest of its groups."""
    blocks = composed(docs, scratch, a, b)
    counts = scratch.table(pair_counts(blocks), "counts")
    held = blocks.select(F.col("block").alias("of"), F.explode(F.arrays_zip("places", "pairs")).alias("x")).select("of", F.col("x.places").alias("place"), F.col("x.pairs").alias("pair"))
    back = held.join(counts, "pair").select("of", "place", "n", F.col("best").cast("long").alias("best"))
    return blocks.drop("pairs", "docs", "places").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_finish, _ROWS)
