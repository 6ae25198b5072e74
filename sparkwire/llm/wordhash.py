"""Vectorised word, shingle and line hashing over Arrow string columns.

A batch of texts is one UTF-8 byte buffer with offsets. Words are the runs of
bytes outside ``\\x20`` and ``\\x09-\\x0D``; as UTF-8 never holds those bytes inside
a longer character, this equals the pattern ``[^\\x20\\x09-\\x0D]+`` over characters.

A span is hashed eight bytes at a time, each step mixing all bits of the state before the next bytes come in; a span
of more than ``_LONG`` bytes by BLAKE2. So no structure of a text, such as a word whose halves mirror each other, makes two
spans meet: different words, shingles or lines of one text have one 64-bit hash with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 256
_SEED, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # the first k of eight bytes


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Texts:
    """Some texts of a batch: bytes, doc offsets, word spans and span hashing."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.raw = data
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        ws = _WS[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ws[:-1]
        after = np.ones(n, bool)
        after[:-1] = ws[1:]
        self.nonws = ~ws
        self.starts = np.flatnonzero(self.nonws & (before | cut[:-1]))
        self.ends = np.flatnonzero(self.nonws & (after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # index of each text's first word, with an end
        self.n_words = np.diff(self.first)
        self._eights = None

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each byte span."""
        if self._eights is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            #: The eight bytes from each place on.
            self._eights = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), padded, 0, (1,))
        sizes = ends - starts
        h = mix(sizes.astype(np.uint64) * _STEP + _SEED)
        live, at = np.flatnonzero((sizes > 0) & (sizes <= _LONG)), 0
        while len(live):
            left = sizes[live] - at
            part = self._eights[starts[live] + at] & _TAIL[np.minimum(left, 8)]
            h[live] = mix((h[live] ^ part) * _STEP + _SEED)
            at += 8
            live = live[left > 8]
        for i in np.flatnonzero(sizes > _LONG).tolist():
            h[i] = int.from_bytes(blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def words(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def shingles(self, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(text index, hash) of each k-word window; a text of 1..k-1 words gives its whole sequence."""
        w, n = self.words(), self.n_words
        doc = np.repeat(np.arange(len(n)), n)
        last = len(w) - k + 1
        if last > 0:
            ok = doc[:last] == doc[k - 1 :]
            h = np.zeros(last, np.uint64)
            for j in range(k):
                h = (h + w[j : j + last]) * U(0xFF51AFD7ED558CCD) ^ (h >> U(29))
            docs, hashes = doc[:last][ok], mix(h[ok] + U(k))
        else:
            docs, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        short = np.flatnonzero((n > 0) & (n < k))
        if whole_if_short and len(short):
            h = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = n[short] > j
                x = (h[has] + w[self.first[short][has] + j]) * U(0xFF51AFD7ED558CCD) ^ (h[has] >> U(29))
                h[has] = x
            docs = np.concatenate([docs, short])
            hashes = np.concatenate([hashes, mix(h + n[short].astype(np.uint64))])
        return docs, hashes


def distinct(docs: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, flat, with offsets."""
    order = np.lexsort((hashes, docs))
    d, h = docs[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    d, h = d[new], h[new]
    return h, np.searchsorted(d, np.arange(n_docs + 1))


def slices(column: pa.Array, lower: bool, most_bytes: int = 1 << 19, most_rows: int = 2048) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive runs of rows whose texts together hold about most_bytes; a longer text comes alone.

    A null text counts as empty. Memory is bounded by most_rows texts of a batch or the longest one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first in range(0, len(column), most_rows):
        rows = column.slice(first, most_rows).cast(pa.large_string()).fill_null("")
        bufs = rows.buffers()
        offsets = np.frombuffer(bufs[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
            to = min(to, len(rows))
            yield first + at, first + to, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
            at = to
