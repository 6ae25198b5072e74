"""Document fingerprints: a Merkle tree over a text's sections, paragraphs and pieces.

A paragraph is a line with its line feed. Pieces are a paragraph's sentences; a longer one is cut after words chosen by their own
bytes, so that an edit moves no other border. A section ends with a blank line, before a heading, or after a paragraph chosen
by its digest. Every digest is taken over the digests below it, so equal roots mean equal texts, and two trees are compared by going down
only where digests differ: :func:`edits` tells which parts of one text the other does not have in that place.

The fingerprint is a line: the root in hex, a colon, and the tree of short piece codes (five characters a piece, paragraphs closed
by ``,`` and sections by ``;``). :func:`likeness` needs nothing else: the share of pieces that two trees have in common.

Each text meets the next one by id in a sorted pass over range partitions, one shuffle of the texts; only the first text of each partition
is brought to the last one of the partition before.

Defined results: a null text is empty; an empty text has a tree without pieces. Documents of one id, or of none (they come first), are in the order of a hash of
their texts. A document that is alone is its own next. An empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from base64 import urlsafe_b64encode
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch

_BORDER = re.compile(r"\n|[.!?](?=[^\S\n])")
_WORD = re.compile(r"\S+")
_LONG = 256  # characters of a sentence beyond which it is cut at words; a word is never cut
_CODE = 5


def _digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


class Tree:
    """Digests of sections, paragraphs and pieces; ``*_ends`` say how many of the level below each one closes."""

    def __init__(self, text: str):
        self.piece_ends, lines = _borders(text)
        raw = [text[a:b].encode() for a, b in zip([0, *self.piece_ends], self.piece_ends)]  # noqa: B905
        self.pieces = list(map(_digest, raw))
        self.paragraph_ends = lines
        self.paragraphs = _above(self.pieces, lines, b"p")
        self.section_ends = []
        first = 0
        for k, end in enumerate(lines):
            line = b"".join(raw[first:end])
            if line.startswith(b"#") and k and (not self.section_ends or self.section_ends[-1] != k):
                self.section_ends.append(k)
            if not line.strip() or self.paragraphs[k][0] < 16:
                self.section_ends.append(k + 1)
            first = end
        if lines and (not self.section_ends or self.section_ends[-1] != len(lines)):
            self.section_ends.append(len(lines))
        self.sections = _above(self.paragraphs, self.section_ends, b"s")
        self.root = sha256(b"r" + b"".join(self.sections)).hexdigest()
        self.codes = [urlsafe_b64encode(d[:6])[:_CODE].decode() for d in self.pieces]

    def fingerprint(self) -> str:
        paragraphs = ["".join(self.codes[a:b]) + "," for a, b in zip([0, *self.paragraph_ends], self.paragraph_ends)]  # noqa: B905
        sections = ["".join(paragraphs[a:b]) + ";" for a, b in zip([0, *self.section_ends], self.section_ends)]  # noqa: B905
        return self.root + ":" + "".join(sections)


def _above(below: list[bytes], ends: list[int], kind: bytes) -> list[bytes]:
    return [_digest(kind + b"".join(below[a:b])) for a, b in zip([0, *ends], ends)]  # noqa: B905


def _borders(text: str) -> tuple[list[int], list[int]]:
    """Where pieces end, and after how many pieces each paragraph ends."""
    ends, lines, at = [], [], 0
    for m in _BORDER.finditer(text):
        end = m.end()
        if end - at > _LONG:
            _cut(text, at, end, ends)
        ends.append(end)
        at = end
        if text[end - 1] == "\n":
            lines.append(len(ends))
    if at < len(text):
        if len(text) - at > _LONG:
            _cut(text, at, len(text), ends)
        ends.append(len(text))
        lines.append(len(ends))
    return ends, lines


def _cut(text: str, at: int, end: int, ends: list[int]) -> None:
    for w in _WORD.finditer(text, at, end):
        if crc32(w.group().encode()) % 16 == 0 and at < w.end() < end:
            ends.append(w.end())


def fingerprint(text: str | None) -> str:
    return Tree(text or "").fingerprint()


def _like(root_a: str, root_b: str, a: list[str], b: list[str]) -> float:
    """Twice the pieces that both have over the pieces of both. 1 for equal roots alone: pieces in another order count as half a piece less."""
    if root_a == root_b:
        return 1.0
    n = len(a) + len(b)
    return min(2 * (Counter(a) & Counter(b)).total(), n - 0.5) / n


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1."""

    def read(f: str) -> tuple[str, list[str]]:
        root, _, tree = f.partition(":")
        codes = re.sub("[,;]", "", tree)
        return root, [codes[i : i + _CODE] for i in range(0, len(codes), _CODE)]

    (root_a, x), (root_b, y) = read(a), read(b)
    return _like(root_a, root_b, x, y)


def _runs(a: list[bytes], b: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """Runs (of a from, to, of b from, to) that differ, between digests that stand once in both and in one order."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    end_a, end_b = len(a) - hi, len(b) - hi
    count_a, count_b = Counter(a[lo:end_a]), Counter(b[lo:end_b])
    place = {d: j for j, d in enumerate(b[lo:end_b], lo) if count_b[d] == 1}
    at_a, at_b = lo, lo
    for i, j in _rising([(i, place[d]) for i, d in enumerate(a[lo:end_a], lo) if count_a[d] == 1 and d in place]):
        if i > at_a or j > at_b:
            yield at_a, i, at_b, j
        at_a, at_b = i + 1, j + 1
    if end_a > at_a or end_b > at_b:
        yield at_a, end_a, at_b, end_b


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises on both sides."""
    tops, held, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(held[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            held.append(k)
        else:
            tops[at], held[at] = j, k
    out, k = [], held[-1] if held else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def edits(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """Spans of code points (of a from, to, of b from, to) that differ, found by going down from the roots where digests differ."""
    if a.root == b.root:
        return []
    first = lambda ends, k: ends[k - 1] if k else 0
    out = []
    for s, t, u, v in _runs(a.sections, b.sections):
        p, q, x, y = first(a.section_ends, s), first(a.section_ends, t), first(b.section_ends, u), first(b.section_ends, v)
        for i, j, k, m in _runs(a.paragraphs[p:q], b.paragraphs[x:y]):
            e, f, g, h = first(a.paragraph_ends, p + i), first(a.paragraph_ends, p + j), first(b.paragraph_ends, x + k), first(b.paragraph_ends, x + m)
            for c, d, z, w in _runs(a.pieces[e:f], b.pieces[g:h]):
                out.append((first(a.piece_ends, e + c), first(a.piece_ends, e + d), first(b.piece_ends, g + z), first(b.piece_ends, g + w)))
    return out


_FIELDS = {
    "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "edit_from": pa.int64(), "edit_to": pa.int64(),
}
_SQL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_from long, edit_to long"


def _row(text: str, tree: Tree, after: str, tree_after: Tree) -> tuple:
    """The columns of a document. ``edit_from`` and ``edit_to`` enclose what the edited text has not in place."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    other = Tree(edited)
    spans = edits(tree, other)
    return (
        len(text), sha256(edited.encode()).hexdigest(), tree.fingerprint(), other.fingerprint(), _like(tree.root, other.root, tree.codes, other.codes),
        _like(tree.root, tree_after.root, tree.codes, tree_after.codes), min((s[0] for s in spans), default=None), max((s[1] for s in spans), default=None),
    )


_INNER, _HEAD, _LAST = 0, 1, 2


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts: each with its next one; the first and the last of the partition are given on with their texts."""
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), *_FIELDS.items()])
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        before = None
        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = x.as_py()
                tree = Tree(text)
                if before is None:
                    yield (part, _HEAD, doc, text, *[None] * len(_FIELDS))
                else:
                    yield (part, _INNER, before[0], None, *_row(before[1], before[2], text, tree))
                before = doc, text, tree
        if before is not None:
            yield (part, _LAST, before[0], before[1], *[None] * len(_FIELDS))

    yield from _batches(rows(), schema)


def _last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *_FIELDS.items()])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc, text, after in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("after"), strict=True):
                t, n = text.as_py(), after.as_py()
                yield (doc, *_row(t, Tree(t), n, Tree(n)))

    yield from _batches(rows(), schema)


def fingerprints(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each document: its fingerprint, that of its edited text (the last half replaced by the start of the next document), likenesses, and where the edit lies."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())  # equal rows may fill several partitions
    order = ["doc_id", "h", "tie"]
    walked = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_walk, f"part int, kind int, doc_id long, text string, {_SQL}")
    walked = scratch.table(walked, "walked")
    # a row for each partition: which one that has rows comes after it, the first one after the last
    heads = walked.where(F.col("kind") == _HEAD)
    parts = heads.agg(F.sort_array(F.collect_list("part")).alias("parts")).select(F.posexplode("parts").alias("k", "part"), "parts")
    following = parts.select("part", F.get("parts", (F.col("k") + 1) % F.size("parts")).alias("next_part"))
    last = walked.where(F.col("kind") == _LAST).select("part", "doc_id", "text").join(following, "part")
    last = last.join(heads.select(F.col("part").alias("next_part"), F.col("text").alias("after")), "next_part")
    columns = ["doc_id", *_FIELDS]
    inner = walked.where(F.col("kind") == _INNER).select(columns)
    return inner.unionByName(last.select("doc_id", "text", "after").mapInArrow(_last_rows, f"doc_id long, {_SQL}"))
