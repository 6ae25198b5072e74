"""Token ids of whole texts, from a public tokenizer file, with an exact memory of part ids.

A byte-pair tokenizer first cuts a text into pieces and then merges inside each piece. A text may
therefore be cut where no piece can cross, every different part be encoded once by the
tokenizers library, and the ids be joined. Two settings of a file allow that:

* white space kept: byte-level pieces by the pattern `` ?letters| ?digits| ?other|white space``.
  Parts are words with the space before them, and what is left of each run of white space.
* white space dropped: it only ends pieces. Parts are the words.

:func:`cut_of` reads the file's settings; a file with any other is given whole texts. A text is given to
the library as a whole, too, where white space beyond ASCII stands in it.

The memory finds all parts of a slice at once: a table of part hashes, with each part's bytes, which are
compared, so that two parts of one hash never share ids. It holds at most ``most`` parts; beyond that, or beyond
16 bytes a part, the half that is used least is forgotten: about 50 MB in a worker.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import cache

import numpy as np
import pyarrow as pa

from sparkwire.llm.wordhash import Texts, slices

_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_IS_PUNCTUATION, _IS_ALNUM = np.zeros((2, 256), bool)
_IS_PUNCTUATION[list(string.punctuation.replace("'", "").encode())] = True
_IS_ALNUM[list((string.ascii_letters + string.digits).encode())] = True
_TAIL = 8  # characters of punctuation that are looked at; longer runs stay with their word
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_CHUNK = 1 << 17  # parts that are found at once; half of the memory at most


def cut_of(path: str) -> str | None:
    """"kept" or "dropped" as the file treats white space, None if texts can't be cut."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, first = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec.get("truncation") or spec.get("padding"):
        return None
    if spec.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first["add_prefix_space"]:
        return "kept"
    steps, cuts = (spec.get("normalizer") or {}).get("normalizers", []), first.get("pretokenizers", [])
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    white = steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
    words = cuts[0]["pattern"] == {"Regex": _WORDS} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    return "dropped" if white and words and not cuts[1]["add_prefix_space"] and not cuts[1].get("use_regex", True) else None


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Memory:
    """Part hash -> bytes and ids, as flat arrays behind an open-addressing table."""

    def __init__(self, most: int, dtype: np.dtype):
        self.most, self.bits, self.dtype = most, max(4, (2 * most - 1).bit_length()), dtype
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.hash = np.zeros(most, np.uint64)
        #: Of each part: where its bytes begin, how many, where its ids begin, how many (-1: the whole text is to be encoded), its uses.
        self.at, self.id_at, self.uses = np.zeros((3, most), np.int64)
        self.size, self.count = np.zeros((2, most), np.int32)
        self.n = 0
        self.text, self.text_n = np.zeros(1 << 16, np.uint8), 0
        self.ids, self.ids_n = np.zeros(1 << 16, dtype), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.entry[slot], -1)
        live = np.flatnonzero((key != h) & (key != 0))
        while len(live):
            slot[live] = (slot[live] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[live]]
            hit = key == h[live]
            out[live[hit]] = self.entry[slot[live[hit]]]
            live = live[~hit & (key != 0)]
        return out

    def full(self, more: int) -> bool:
        return self.n + more > self.most or self.text_n > 16 * self.most

    def halve(self) -> None:
        """Forget all but the parts that are used most, at most half of the room."""
        n = min(self.n, self.most // 2)
        keep = np.sort(np.argpartition(self.uses[: self.n], self.n - n)[self.n - n :]) if n else np.zeros(0, np.int64)
        keep = keep[np.cumsum(self.size[keep], dtype=np.int64) <= 8 * self.most]
        text, ids = self.text[_ranges(self.at[keep], self.size[keep])], self.ids[_ranges(self.id_at[keep], np.maximum(self.count[keep], 0))]
        h, sizes, counts, uses = self.hash[keep], self.size[keep].copy(), self.count[keep].copy(), self.uses[keep] // 2
        self.keys[:] = 0
        self.n = self.text_n = self.ids_n = 0
        self.add(h, text, sizes, ids, counts)
        self.uses[: len(keep)] = uses

    def add(self, h: np.ndarray, text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New different hashes with the bytes and ids of their parts; room for them is the caller's concern."""
        new, real = slice(self.n, self.n + len(h)), np.maximum(counts, 0)
        self.hash[new], self.size[new], self.count[new], self.uses[new] = h, sizes, counts, 0
        self.at[new], self.id_at[new] = self.text_n + np.cumsum(sizes) - sizes, self.ids_n + np.cumsum(real) - real
        self.text, self.text_n = self._append(self.text, self.text_n, text)
        self.ids, self.ids_n = self._append(self.ids, self.ids_n, ids)
        self.n += len(h)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]  # of several for one slot the last stays
            self.entry[slot[free]] = new.start + free
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _append(store: np.ndarray, n: int, new: np.ndarray) -> tuple[np.ndarray, int]:
        if n + len(new) > len(store):
            store = np.concatenate([store[:n], np.zeros(n // 2 + 2 * len(new), store.dtype)])
        store[n : n + len(new)] = new
        return store, n + len(new)


class Encoder:
    def __init__(self, path: str, most: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings are ordinary text
        self.cut = cut_of(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        # what stands between parts that are encoded in one go; no part holds it
        self.mark = "\n" if self.cut == "kept" else " ~ "
        mark = self.whole(self.mark)
        self.mark_id = int(mark[0])
        if len(mark) != 1:
            self.cut = None
        self.memory = _Memory(most if self.cut else 1, self.dtype)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learned(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different parts, one after the other, and their numbers; -1 where the whole text has to be encoded."""
        texts, sign = [p.decode("utf-8", "replace") for p in parts], self.mark.strip(" ")
        joined = self.mark.join(texts)
        if not _OTHER_SPACE.search(joined) and joined.count(sign) == len(texts) - 1:
            ids = self.whole(joined)
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) == len(texts) - 1:
                return ids[ids != self.mark_id], np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        if len(parts) == 1:
            ids = self.whole(texts[0])
            return (ids[:0], np.array([-1])) if _OTHER_SPACE.search(joined) else (ids, np.array([len(ids)]))
        # some part is odd: halves of the list find it
        half = len(parts) // 2
        one, two = self._learned(parts[:half]), self._learned(parts[half:])
        return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])

    def _parts(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the parts of all texts, in order."""
        starts, ends = t.starts, t.ends
        more = []
        if self.cut == "kept":
            gap = np.empty(len(starts), np.int64)  # where the white space before a word begins
            gap[1:] = ends[:-1]
            has = t.n_words > 0
            gap[t.first[:-1][has]] = t.offsets[:-1][has]
            spaced = starts > gap
            spaced[spaced] = t.raw[starts[spaced] - 1] == 32
            starts = starts - spaced  # a single space belongs to the word after it
            left = starts - gap
            # what is left is one piece; but if the word takes no space, the last character is a piece of its own
            one, two = np.flatnonzero(left > 0), np.flatnonzero((left > 1) & ~spaced)
            last = t.offsets[:-1].copy()
            last[has] = ends[t.first[1:][has] - 1]
            tail = np.flatnonzero(last < t.offsets[1:])
            more = [(np.where(spaced[one], gap[one], starts[one] - 1), starts[one]), (gap[two], starts[two] - 1), (last[tail], t.offsets[1:][tail])]
        # punctuation after a letter or digit is a piece of its own
        stem, live = ends.copy(), np.arange(len(ends))
        for _ in range(_TAIL):
            live = live[_IS_PUNCTUATION[t.raw[stem[live] - 1]]]
            live = live[stem[live] - 1 > starts[live]]
            stem[live] -= 1
        stem = np.where(_IS_ALNUM[t.raw[stem - 1]], stem, ends) if len(stem) else stem
        cut = np.flatnonzero(stem < ends)
        more.append((stem[cut], ends[cut]))
        s, e = (np.concatenate(x) for x in zip((starts, stem), *more, strict=True))
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and where each text's begin, with an end."""
        n_docs = len(t.offsets) - 1
        if self.cut is None:
            return self._joined([self.whole(self._text(t, i)) for i in range(n_docs)])
        starts, ends = self._parts(t)
        doc = np.searchsorted(t.offsets, starts, "right") - 1
        counts, found, odd, m = np.zeros(n_docs, np.int64), [], np.zeros(n_docs, bool), self.memory
        chunk = max(1, min(_CHUNK, m.most // 2))
        for i in range(0, len(starts), chunk):
            s, e, d = starts[i : i + chunk], ends[i : i + chunk], doc[i : i + chunk]
            entry, wrong = self._entries(t, s, e)
            n = m.count[entry]
            wrong |= n < 0
            odd[d[wrong]] = True
            n = np.where(wrong, 0, n)
            found.append(m.ids[_ranges(m.id_at[entry], n)])
            counts += np.bincount(d, n, n_docs).astype(np.int64)
        ids = np.concatenate(found) if found else np.zeros(0, self.dtype)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if odd.any():
            return self._joined([self.whole(self._text(t, i)) if odd[i] else ids[offsets[i] : offsets[i + 1]] for i in range(n_docs)])
        return ids, offsets

    def _entries(self, t: Texts, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The memory's entry of each part, and whether it is another part's that has the same hash."""
        m, h = self.memory, t.spans(s, e) | np.uint64(1)  # 0 marks a free place
        entry = m.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            different, at = np.unique(h[new], return_index=True)
            if m.full(len(at)):
                m.halve()
                entry = m.find(h)
                new = np.flatnonzero(entry < 0)
                different, at = np.unique(h[new], return_index=True)
            first = new[at]
            sizes = e[first] - s[first]
            data = t.raw[_ranges(s[first], sizes)]
            raw, cut = data.tobytes(), np.concatenate([[0], np.cumsum(sizes)]).tolist()
            parts = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            got = [self._learned(parts[i : i + 4096]) for i in range(0, len(parts), 4096)]
            m.add(different, data, sizes, np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            entry[new] = m.find(h[new])
        m.uses += np.bincount(entry, minlength=m.most)
        size = e - s
        wrong = m.size[entry] != size
        same = np.where(wrong, 0, size)
        differ = t.raw[_ranges(s, same)] != m.text[_ranges(m.at[entry], same)]
        if differ.any():
            wrong[np.searchsorted(np.cumsum(same), np.flatnonzero(differ), "right")] = True
        return entry, wrong

    def _text(self, t: Texts, i: int) -> str:
        return t.raw[t.offsets[i] : t.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def _joined(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(ids) if ids else np.zeros(0, self.dtype), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)

    def ended(self, t: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, each text closed by the end id."""
        ids, offsets = self.encode(t)
        kind = self.dtype if end_id < 1 << (8 * self.dtype.itemsize) else np.dtype("<u4")
        return np.insert(ids.astype(kind, copy=False), offsets[1:], kind.type(end_id)), offsets + np.arange(len(offsets))

    def of_column(self, column: pa.Array, end_id: int):
        """(first row, ids, offsets) of consecutive runs of rows, each text closed by the end id; a null text is empty."""
        for lo, _, t in slices(column, lower=False, most_bytes=1 << 18):
            yield lo, *self.ended(t, end_id)
        pa.default_memory_pool().release_unused()


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
