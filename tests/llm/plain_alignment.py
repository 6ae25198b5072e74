"""A plain version of the alignment: whole texts, offsets in dictionaries."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_REST = [x for x in range(256) if x not in _VISIBLE]


def _a_bytes(token):
    return bytes(ord(c) if ord(c) in _VISIBLE else _REST[ord(c) - 256] for c in token)


def _b_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def groups(text):
    """[(a ids, b ids)] or None."""
    if not text:
        return None
    x = A.encode(" " + text, add_special_tokens=False).ids
    y = B.encode(text)
    xs, ys = [_a_bytes(A.id_to_token(i)) for i in x], [_b_bytes(i) for i in y]
    if not b"".join(xs) == (" " + text).encode() == b"".join(ys):
        return None

    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    ea, eb = ends(xs), ends(ys)
    both = sorted(set(ea) & set(eb))
    place = {e: k for k, e in enumerate(both)}
    out = [([], []) for _ in both]
    for ids, es, side in ((x, ea, 0), (y, eb, 1)):
        k = 0
        for i, e in zip(ids, es, strict=True):
            out[k][side].append(i)
            if e in place:
                k = place[e] + 1
    return out


def align(docs):
    found = [groups(t) for _, t in docs]
    links = [Counter((a, b) for x, y in g or [] for a in x for b in y) for g in found]
    count = Counter(p for c in links for p in c)
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    rows = []
    for (doc, _), g, c in zip(docs, found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        rows.append((
            doc, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), c.total(),
            sum(n for (a, b), n in c.items() if count[a, b] == best[a]), sum(n * count[p] for p, n in c.items()), sha256(text.encode()).hexdigest() if g else "",
        ))
    return rows
