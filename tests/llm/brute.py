"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs, k, percent):
    """{id: component} of [(id, text)]."""
    s = {i: shingles(t, k) for i, t in docs}
    links = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]) and s[b]]
    return components(s, links)


def best_fit(lengths, capacity):
    """Rooms left after placing one at a time, the longest first, each into the tightest bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def kept(text, bands):
    """The compression bands' verdict: whole texts by the limits of their length, longer ones by chunks too."""
    import zstandard

    raw, z = (text or "").encode(), zstandard.ZstdCompressor(level=bands.level)
    if quality(text)[5]:
        return False
    within = lambda n: max(x for x in bands.whole if x[0] <= n)[1:]
    ratio = lambda b: len(z.compress(b)) / len(b)
    bad = 0
    for i in range(0, len(raw), bands.chunk_bytes):
        c = raw[i : i + bands.chunk_bytes]
        least, most = (bands.chunk_least, bands.chunk_most) if len(c) == bands.chunk_bytes else within(len(c))
        bad += 0 if least <= ratio(c) <= most else len(c)
    least, most = within(len(raw))
    return least <= ratio(raw) <= most and (len(raw) <= bands.chunk_bytes or bad <= bands.chunk_share * len(raw))
