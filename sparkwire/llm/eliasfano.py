"""Elias-Fano coding of sorted integers, with vectorised access and successor search over mapped memory."""

from __future__ import annotations

import numpy as np

U = np.uint64
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SEL = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SEL[_b, _r] = _i


def _select_in(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th set bit (from 0) of each 64-bit word."""
    by = words.view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_POP[by], axis=1, dtype=np.int64)
    byte = (upto <= rank[:, None]).sum(axis=1)
    rows = np.arange(len(words))
    before = np.where(byte > 0, upto[rows, byte - 1], 0)
    return byte * 8 + _SEL[by[rows, byte], rank - before]


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays for sorted ``values`` below ``universe``: upper parts in unary, lower parts packed."""
    n = len(values)
    values = values.astype(np.uint64)
    low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
    places = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
    n_bits = n + (universe >> low_bits) + 1
    bits = np.zeros((n_bits + 63) // 64 * 64, np.uint8)
    bits[places] = 1
    upper = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.zeros(len(upper) + 1, np.int64)
    np.cumsum(_POP[upper.view(np.uint8).reshape(-1, 8)].sum(axis=1, dtype=np.int64), out=ones[1:])
    lower = np.zeros(n * low_bits // 64 + 2, np.uint64)
    if low_bits:
        low = values & U((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.uint64) * U(low_bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(lower, word, low << shift)
        over = shift + U(low_bits) > U(64)
        np.bitwise_or.at(lower, word[over] + 1, low[over] >> (U(64) - shift[over]))
    return {"meta": np.array([n, low_bits, n_bits], np.int64), "upper": upper, "ones": ones, "lower": lower}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits, self.n_bits = (int(x) for x in arrays["meta"])
        self.upper, self.ones, self.lower = arrays["upper"], arrays["ones"], arrays["lower"]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * U(self.low_bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        low = self.lower[word] >> shift
        over = shift > U(64 - self.low_bits)
        low[over] |= self.lower[word[over] + 1] << (U(64) - shift[over])
        return low & U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in(np.ascontiguousarray(self.upper[word]), i - self.ones[word])
        return ((place - i).astype(np.uint64) << U(self.low_bits)) | self._low(i)

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values have an upper part of at most k."""
        # zeros up to a word are 64 * words - ones: sorted as well, so they are searched without being stored
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), len(self.upper), np.int64)
        while True:
            open_ = hi - lo > 1
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            up = open_ & (mid * 64 - self.ones[mid] <= k)
            lo = np.where(up, mid, lo)
            hi = np.where(open_ & ~up, mid, hi)
        word = ~np.ascontiguousarray(self.upper[lo])
        place = lo * 64 + _select_in(word, k - (lo * 64 - self.ones[lo]))
        return place - k

    def successor(self, keys: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The first index in [lo, hi) whose value is at least the key, else hi."""
        keys = keys.astype(np.uint64)
        upper = (keys >> U(self.low_bits)).astype(np.int64)
        a = np.where(upper > 0, self._ones_before_zero(np.maximum(upper - 1, 0)), 0)
        b = self._ones_before_zero(upper)
        if lo is not None:
            a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        low = keys & U((1 << self.low_bits) - 1)
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                return a
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < low[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)

    def find(self, keys: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The index of each key, or -1."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        i = self.successor(keys, lo, hi)
        ok = i < (self.n if hi is None else hi)
        ok[ok] = self.access(i[ok]) == keys[ok].astype(np.uint64)
        return np.where(ok, i, -1)
