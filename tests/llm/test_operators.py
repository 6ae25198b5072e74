import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwire.llm import embeddings, html, lm, minhash, mixing, packing, quality, records, sharding, tokenids, urls
from sparkwire.llm.components import connect
from sparkwire.llm.eliasfano import EliasFano, encode
from sparkwire.llm.queries import URL_RULES, tokenizer_path
from sparkwire.llm.scratch import Scratch
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _m string, key int, id string, size int"


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "test")


def corpus(seed=5, n=60):
    """Texts with exact copies, near copies in chains, shared passages, odd and empty ones."""
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["Straße", "ÉTÉ", "字", "don't", "a,b", "#x", "100%"]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 8, 30, 60, 200, 400]))] for _ in range(n)]
    for i in range(n // 2):
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(w) // 40))):
            w[r.randrange(len(w))] = r.choice(vocab)
        base.append(w)
    texts = [" ".join(w) for w in base] + [base[0][0], "", None, "   \n\t", "One Two", "one two", " ".join(base[3]).upper()]
    chain = [r.choice(vocab) for _ in range(300)]
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = list(chain)
        for _ in range(4):
            chain[r.randrange(len(chain))] = r.choice(vocab)
    texts += ["lang " * 30000, "\n".join(["same line here"] * 40)]
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, [None, "a", "b", "z", "é"][(i or 0) % 5], None, "clash", 1, "x", 2) for i, t in docs], DOCS)


# --- 1 -----------------------------------------------------------------------
@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, scratch, k, percent):
    docs = corpus()
    near = minhash.Near(shingle=k, similar=percent, block=4, short=100)
    got = minhash.near_duplicates(frame(spark, docs), scratch, near).collect()
    want = brute.near(docs, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(brute.shingles(dict(docs)[r["doc_id"]], k)) and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)
    kept = minhash.keep_one(frame(spark, docs), scratch, near)
    assert kept.columns == frame(spark, docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_edges(spark, scratch):
    assert minhash.near_duplicates(frame(spark, []), scratch).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "q r s t u v"), (3, "A B C D E F")]
    got = minhash.near_duplicates(frame(spark, rows), scratch).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == {(7, 3, False): 2, (None, None, True): 1, (3, 3, True): 1}
    assert sorted(str(r["doc_id"]) for r in minhash.keep_one(frame(spark, [*rows, (9, "z"), (9, "z")]), scratch).collect()) == ["3", "9", "None"]


def test_bands_lose_no_link():
    """At the limit, over small sets and large ones."""
    r = np.random.default_rng(3)
    for near in (minhash.Near(3, 85), minhash.Near(5, 80)):
        for n in [5, 6, 7, 9, 12, 20, 33, 60, 100, 150, 200, 300, 600, 1500, 6000]:
            d = int(n * (100 / near.similar - 1))
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a, r.integers(0, 2**64, d, dtype=np.uint64)]))
            regs = minhash.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            rows, keys, _ = minhash.band_keys(regs, np.array([len(a), len(b)]), near)
            assert set(keys[rows == 0]) & set(keys[rows == 1]), (near, n)
            est, used = minhash.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))
            assert minhash.passes(est, used, np.array([len(a)]), np.array([len(b)]), near).all()


def test_components(spark, scratch):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)] + [(4, 4)]
    got = {x["node"]: x["root"] for x in connect(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute.components(nodes, [(a, b) for a, b in links if a != b])
    assert connect(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


# --- 2 -----------------------------------------------------------------------
def test_embeddings_equal_brute_force(spark, scratch):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 24))
    x[100:180] = x[0] + 0.04 * r.standard_normal((80, 24))
    x[180:220] = x[:40] * 3 + 0.02 * r.standard_normal((40, 24))
    rows = [(i, [float(v) for v in x[i]], i % 2 if i < 100 else 0, 1) for i in range(300)]
    rows += [(300, None, 0, 1), (301, [0.0] * 24, 0, 1), (302, [float("nan")] * 24, 0, 1), (303, rows[0][1], None, 1), (304, [], 0, 1), (305, [None] * 24, 0, 1), (306, [1.0, 2.0], 0, 1), (307, [1e200, 2e200], 0, 1)]
    rows += [(None, rows[0][1], 0, 1), (400, rows[0][1], 0, 1), (401, rows[0][1], 0, 1), (401, rows[0][1], 0, 1), (402, rows[3][1], 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell int")
    got = embeddings.near_duplicates(df, scratch, embeddings.Counting(block=16)).collect()
    assert len(got) == len(rows)
    links, n = [], [0] * len(rows)
    unit = [None if i is None or l is None or not v or None in v or not np.isfinite(v).all() or not any(v) else (np.array(v) / max(map(abs, v))) / np.linalg.norm(np.array(v) / max(map(abs, v))) for i, v, l, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98:
                links.append((rows[a][0], rows[b][0]))
                n[a], n[b] = n[a] + 1, n[b] + 1
    want = brute.components([q[0] for q in rows if q[0] is not None], links)
    assert len(links) > 3000
    assert Counter((q["vec_id"], q["n_links"], q["component_id"]) for q in got) == Counter((q[0], m, want.get(q[0])) for q, m in zip(rows, n, strict=True))
    assert embeddings.near_duplicates(df.limit(0), scratch).count() == 0


def test_embeddings_keep_links_at_the_limit(spark, scratch):
    """Vectors around a few centres, at cosines of 0.98 to 0.985 from them: no link is lost."""
    r = np.random.default_rng(7)
    n, dim, rows, want = 1500, 64, [], {}
    for g in range(6):
        centre = r.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        y = r.standard_normal((n, dim))
        y -= (y @ centre)[:, None] * centre
        y /= np.linalg.norm(y, axis=1)[:, None]
        c = r.uniform(0.98001, 0.985, n)[:, None]
        x = np.vstack([centre, c * centre + np.sqrt(1 - c * c) * y])
        near = (x @ x.T >= 0.98).sum(axis=1) - 1
        for k in range(n + 1):
            want[len(rows)] = int(near[k])
            rows.append((len(rows), x[k].tolist(), g))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {q["vec_id"]: (q["n_links"], q["component_id"]) for q in embeddings.near_duplicates(df, scratch).collect()}
    assert {i: q[0] for i, q in got.items()} == want
    assert {i: q[1] for i, q in got.items()} == {i: i - i % (n + 1) for i in want}


# --- 3 and 5 -------------------------------------------------------------------
ODD = ["", " a", "a ", "a  b", "a\n\nb", "x y z  b", "don't we'll", "~ a~b", "10 20", "ß É́ é", "<|endoftext|> x", "tab\there", "a...b !!! »...", "İ ΣΑΣ", "日本語　終", "a\x1cb", "\r\n\r\nab", "'s 's"]


@pytest.mark.parametrize("name, most", [("byte_bpe_50k.json", 1 << 16), ("word_bpe_49k.json", 1 << 16), ("byte_bpe_50k.json", 16)])
@given(st.lists(st.lists(st.sampled_from([*"aB é\n'~.%7\tΣ字　\xa0s", "<|endoftext|>"]), max_size=30).map("".join), max_size=8))
@settings(max_examples=60, deadline=None)
def test_ids_are_the_librarys(name, most, texts):
    e = encoder_of(name, most)
    assert e.cut
    assert ids_of(e, [*texts, *ODD, None]) == [e.whole(t).tolist() for t in [*texts, *ODD, ""]]


@cache
def encoder_of(name, most):
    return tokenids.Encoder(tokenizer_path(name), most)


def ids_of(e, texts):
    out = []
    for lo, ids, offsets in e.of_column(pa.array(texts, pa.string()), 7):
        assert lo == len(out)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            assert ids[b - 1] == 7
            out.append(ids[a : b - 1].tolist())
    return out


@pytest.mark.parametrize("most", [50, 1 << 16])
def test_ids_of_long_texts(most):
    texts = [t for _, t in corpus()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokenids.Encoder(tokenizer_path(name), most)
        assert ids_of(e, texts) == [e.whole(t or "").tolist() for t in texts]
        assert e.memory.n <= most


def test_ids_where_hashes_meet(monkeypatch):
    """Parts of one hash are told apart by their bytes."""
    monkeypatch.setattr(tokenids.Texts, "spans", lambda self, s, e: (e - s).astype(np.uint64) * np.uint64(1 << 60))
    e = tokenids.Encoder(tokenizer_path("word_bpe_49k.json"), 64)
    texts = ["ab cd", "cd, ab", "x", "efg hij ab"]
    assert ids_of(e, texts) == [e.whole(t).tolist() for t in texts]


def test_ids_of_an_unknown_file(tmp_path):
    """A file whose settings don't allow cutting is given whole texts."""
    import json

    spec = json.load(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    e = tokenids.Encoder(str(tmp_path / "t.json"))
    assert e.cut is None and ids_of(e, ODD) == [e.whole(t).tolist() for t in ODD]


def test_records_round_trip(spark, scratch, tmp_path):
    docs = [*corpus(n=20), (None, "no id")]
    random.Random(2).shuffle(docs)
    path = tokenizer_path("byte_bpe_50k.json")
    files = records.write(frame(spark, docs).repartition(3), scratch, path, 0)
    got = records.read(files).orderBy("doc_id").collect()
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    e, start = tokenids.encoder(path), 0
    for r, (i, t) in zip(got, docs, strict=True):
        ids = np.append(e.whole(t or ""), 0).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    f = files.orderBy("start").first()
    index = records.read_index(f["file"])
    some = list(records.fetch(f["file"], index, [len(index) - 1, 0]))
    assert [s[0] for s in some] == [index["doc_id"][-1], None]
    local = f["file"].removeprefix("file://").removeprefix("file:")
    data = bytearray(open(local, "rb").read())
    data[20] ^= 1
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(records.Corrupt):
        records.read_frame(open(tmp_path / "x", "rb"))
    empty = records.encode(spark, frame(spark, []), scratch, path, 0)
    assert empty.count() == 0


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_equals_one_at_a_time(lengths):
    rooms, per = defaultdict(lambda: 40), 0
    for length, a, b, first, each, offset in packing.best_fit(Counter(lengths), 40):
        per += b - a
        for r in range(a, b):
            rooms[first + (r - a) // each] -= length
    assert per == len(lengths) and sorted(rooms.values()) == brute.best_fit(lengths, 40)


def test_packing(spark, scratch):
    docs = [*corpus(n=30), (900, "twice"), (900, "twice")]
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack(frame(spark, docs).repartition(3), scratch, path, capacity=256).collect()
    e = tokenids.encoder(path)
    ids = {i: np.append(e.whole(t or ""), 1).astype("<u4") for i, t in docs}
    seen = Counter()
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) * (2 if i == 900 else 1) for i, x in ids.items()}
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end = o + n
        assert end <= 256
    assert len(by) == len(brute.best_fit([r["length"] for r in got], 256))
    assert packing.pack(frame(spark, []), scratch, path).count() == 0


# --- 4 -----------------------------------------------------------------------------
def test_url_rules_and_templates(spark, scratch):
    pages = [(i, u, "x") for i, u in enumerate(
        [f"http://h{i % 7}.example.org/{'es' if i % 3 else 'fr'}/{i + 200}" for i in range(120)]
        + [f"https://shop.example.net/{'es' if i % 2 else 'fr'}/{i}/page" for i in range(40)]
        + [f"https://slugs.example.net/{chr(97 + i % 26)}{chr(97 + i // 26)}x/z" for i in range(60)]
        + ["http://A.Example.ORG/en/12?x#y", "http://org", "http://x.com/de/q", "http://xcom/de/q", None, "no scheme", "http://u.example.com/fr/1://z", "http://example.org/en/1"]
    )]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, host string"), scratch, URL_RULES).collect()}
    assert len(got) == len(pages)
    for i, u, _ in pages:
        rest = u.partition("://")[2] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.rule), default=None)
        g = got[i]
        assert (g["host"], g["path"], g["rule"]) == (host, path, best.rule if best else None)
        assert g["verdict"] == best.verdict if best else g["verdict"] in ("allow", "block")
    net = {g["path"].split("/")[1]: g["verdict"] for g in got.values() if g["host"] == "shop.example.net"}
    assert net == {"es": "block", "fr": "allow"}
    assert {g["template"] for g in got.values() if g["host"] == "slugs.example.net"} == {"/*/z"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), scratch, URL_RULES).count() == 0


# --- 6 ------------------------------------------------------------------------------
@given(st.lists(st.integers(0, 2**40), max_size=80), st.integers(0, 30))
@settings(max_examples=100, deadline=None)
def test_elias_fano(values, shift):
    v = np.unique(np.array(values, np.uint64) >> np.uint64(shift))
    e = EliasFano(encode(v, (1 << 40) + 1))
    q = np.concatenate([v, v + np.uint64(1), np.array([0, 1 << 40], np.uint64)])
    assert (e.access(np.arange(len(v))) == v).all()
    if len(v):
        assert (e.successor(q) == np.searchsorted(v, q)).all()
    assert (e.find(q) == [int(np.searchsorted(v, x)) if x in set(v.tolist()) else -1 for x in q.tolist()]).all()


@pytest.mark.parametrize("partitions", ["4", "5"])
def test_language_model_equals_brute_force(spark, scratch, partitions):
    import math

    docs = corpus(seed=8)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = frame(spark, docs)
        held = df["doc_id"] % 4 == 1
        got = lm.score(df, lm.train(df.where(~held), scratch), held_out=held).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    c, bi, ctx, words = Counter(), Counter(), Counter(), {}
    for i, t in docs:
        w = words[i] = brute.WORD.findall((t or "").translate(brute.LOWER)) + [None]
        if i % 4 != 1:
            c.update(w)
            bi.update(zip([None, *w[:-1]], w, strict=True))
            ctx.update([None, *w[:-1]])
    n, v, d = sum(c.values()), len(c), 0.6
    left = Counter(ctx)
    for (a, _), m in bi.items():
        if m >= 2:
            left[a] -= m - d
    gain = []
    for r in got:
        w, score, before = words[r["doc_id"]], 0.0, None
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        for x in w:
            p = (left[before] / ctx[before] if ctx[before] else 1) * ((c[x] - d) / n if c[x] else d * v / n)
            score += math.log10(p + ((bi[before, x] - d) / ctx[before] if bi[before, x] >= 2 else 0))
            before = x
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < len(w) / 3000
        gain.append(r["score"] - r["base_score"])
    assert sum(gain) > 0
    empty = lm.score(frame(spark, docs[:3]), lm.train(frame(spark, []), scratch)).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in empty)


def test_language_model_keeps_bigrams_seen_once(spark, tmp_path):
    import math
    from zlib import crc32

    from sparkwire.llm.queries import queries

    docs = [(i, t, i) for i, t in corpus(seed=12) if i is not None]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["op6_ngram_trie"](spark, str(tmp_path)).collect()
    c, bi, ctx, after, words = Counter(), Counter(), Counter(), Counter(), {}
    for i, t, _ in docs:
        w = words[i] = brute.WORD.findall((t or "").translate(brute.LOWER)) + [None]
        if crc32(str(i).encode()) % 7 != 2:
            c.update(w)
            bi.update(zip([None, *w[:-1]], w, strict=True))
    for (a, _), m in bi.items():
        ctx[a] += m
        after[a] += 1
    n, v, d, once = sum(c.values()), len(c), 0.6, 0
    for r in got:
        score, before, w = 0.0, None, words[r["doc_id"]]
        for x in w:
            p = (d * after[before] / ctx[before] if ctx[before] else 1) * ((c[x] - d) / n if c[x] else d * v / n)
            score += math.log10(p + ((bi[before, x] - d) / ctx[before] if bi[before, x] else 0))
            once += r["held_out"] and bi[before, x] == 1
            before = x
        assert abs(r["score"] - score) < len(w) / 3000
    assert len(got) == len(docs) and once > 0


# --- 7 -------------------------------------------------------------------------------
LINES = st.lists(st.sampled_from(["a b c", "a b c d", " a b c", "", "é # x", "x y z x y z", "\t"]), max_size=30)


@given(st.lists(st.one_of(st.none(), LINES.map("\n".join)), max_size=6))
@settings(max_examples=80, deadline=None)
def test_quality_counts(texts):
    m = quality.measure(pa.array(texts, pa.string())).to_pylist()
    assert [tuple(list(r.values())[:6]) for r in m] == [brute.quality(t) for t in texts]
    assert not any(r["kept"] and r["base_failed"] for r in m)


def test_quality_bands(spark):
    r = random.Random(1)
    prose = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(900))
    loop = " ".join(f"item {i % 9} of the list" for i in range(500))
    noise = " ".join("".join(chr(r.randrange(33, 127)) for _ in range(12)) for _ in range(900))
    half = prose + " " + " ".join(f"again{i % 3} and so{i % 2}" for i in range(1500))
    docs = frame(spark, [(1, prose), (2, loop), (3, noise), (4, half), (5, None), (6, "")])
    got = {q["doc_id"]: q["reason"] for q in quality.judge(docs).collect()}
    assert got[1] is None and got[5] == got[6] == "base" and None not in (got[2], got[3], got[4])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [q["doc_id"] for q in kept.collect()] == [1]
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_verdict_equals_plain(spark):
    """Whole texts by the limits of their length; all bytes of longer ones by chunks, the last by its own length."""
    import base64

    import zstandard

    bands, r = quality.Bands(), random.Random(5)
    z = zstandard.ZstdCompressor(level=bands.level)
    ratio = lambda b: len(z.compress(b)) / len(b)
    within = lambda n: max(x for x in bands.whole if x[0] <= n)[1:]
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))
    texts = [prose(n) for n in (0, 60, 150, 300, 340, 345, 350, 700, 1500)] + [prose(400) + base64.b64encode(r.randbytes(n)).decode() for n in (100, 1400, 3000)]
    texts += [prose(400) + " again" * n for n in (50, 300, 2000)] + ["é" * 3000, prose(400) * 3]
    for t, got in zip(texts, quality.measure(pa.array(texts, pa.string())).to_pylist(), strict=True):
        raw = t.encode()
        least, most = within(len(raw))
        bad = 0
        for i in range(0, len(raw), 2048):
            c = raw[i : i + 2048]
            lo, hi = (bands.chunk_least, bands.chunk_most) if len(c) == 2048 else within(len(c))
            bad += 0 if lo <= ratio(c) <= hi else len(c)
        ok = not got["base_failed"] and least <= ratio(raw) <= most and (len(raw) <= 2048 or bad <= bands.chunk_share * len(raw)) if raw else False
        assert got["kept"] == ok, (len(raw), got)


def test_bands_tell_labelled_documents_apart():
    """Marked-up word lists of few letter groups, as labelled low-quality documents are, fall below the bands; prose of the same groups stays."""
    r = random.Random(2)
    groups = "th he an in er on re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(r.choice(groups) for _ in range(r.randint(2, 4)))
    for n in (600, 1200, 2500):
        prose = " ".join(r.choice(("the", "of", "and", "to", "is", word())) if r.random() < 0.3 else word() for _ in range(n))
        listed = " | ".join(word() for _ in range(n))
        got = quality.measure(pa.array([prose, listed], pa.string())).to_pylist()
        assert not any(g["base_failed"] for g in got) and [g["kept"] for g in got] == [True, False], (n, got)


# --- 8 ---------------------------------------------------------------------------------
def test_mixing(spark, scratch):
    r = random.Random(6)
    docs = [(i, "w " * r.randint(0, 60) + "# " * (i % 3)) for i in range(800)] + [(900, None), (901, ""), (902, "a b"), (902, "a b")]
    df = spark.createDataFrame([(i, t, None if i % 11 == 0 else "abcd"[min(3, i % 9)], "clash") for i, t in docs], "doc_id long, text string, source string, cut string")
    got = mixing.taken(df, scratch, rows_per_bucket=20).collect()
    again = mixing.taken(df.repartition(5), scratch, rows_per_bucket=33).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    size, target, taken, most = Counter(), {}, Counter(), Counter()
    for q in got:
        size[q["source"]] += q["size"]
        target[q["source"]] = q["target"]
        taken[q["source"]] += q["taken"]
        most[q["source"]] = max(most[q["source"]], q["size"])
        assert q["taken"] <= 3 * q["size"]
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    want, free, left = {}, set(sources), sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        for s in over or free:
            want[s] = 3 * size[s] if over else level * weight[s]
            left -= want[s]
        free -= over or free
    for s in sources:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= most[s]
    copies = Counter(q["doc_id"] for q in mixing.mixed(df, scratch, rows_per_bucket=20).collect())
    words = Counter()
    for q in got:
        words[q["doc_id"], q["size"]] += q["taken"]
    assert all(copies[i] * n == t for (i, n), t in words.items() if n)
    assert mixing.mixed(df, scratch).columns == df.columns
    assert mixing.taken(df.limit(0), scratch).count() == 0


def test_mixing_counts_off_equal_rows(spark, scratch):
    """Rows of one id and text are as many as are wanted, and no weight puts a source into one bucket."""
    rows = [(7, "w " * 50, "a")] * 300 + [(None, "w " * 50, "b")] * 400 + [(i, "x " * 50, "c") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for weight in (None, F.lit(1e-6)):
        got = mixing.taken(df, scratch, weight=weight, rows_per_bucket=20).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
        assert len(got) == 3 and all(abs(q["t"] - q["target"]) <= 25 for q in got)
        n = mixing.mixed(df, scratch, weight=weight, rows_per_bucket=20).groupBy("source").count().collect()
        assert {q["source"]: q["count"] * 50 for q in n} == {q["source"]: q["t"] for q in got}


def test_stages_keep_columns_of_any_name(spark, scratch):
    """Clashing columns go through the stages and come back unchanged."""
    names = "cut _m m p row times r_id k_id v_id target epochs n_buckets cut_bucket p_source source_size key id text_ kept place deal root n".split()
    texts = [(i, " ".join(f"w{i}x{j % 70}y" for j in range(120)), "ab"[i % 2]) for i in range(8)]
    texts += [(i + 8, t, s) for i, t, s in texts]
    df = spark.createDataFrame([(*t, *[f"{n}{t[0]}" for n in names]) for t in texts], ["doc_id", "text", "source", *names])
    for stage in (lambda d: minhash.keep_one(d, scratch), lambda d: mixing.mixed(d, scratch), quality.keep_good):
        got = stage(df)
        assert got.schema.names == df.columns and all(q[n] == f"{n}{q['doc_id']}" for q in got.collect() for n in names)
    assert sorted(q["doc_id"] for q in minhash.keep_one(df, scratch).collect()) == list(range(8))
    packing.pack(df, scratch, tokenizer_path("word_bpe_49k.json")).collect()


# --- 9 -----------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 5, 500])
def test_sharding(spark, scratch, n):
    docs = [(i, "é" * (i % 7)) for i in range(n)] + ([(n, None), (None, "x"), (3, "y"), (3, "y")] if n else [])
    got = sharding.place(frame(spark, docs), scratch, shards=8, vnodes=16).collect()
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_equal_texts_stand_together(spark, scratch):
    """A text's copies go to as few shards as they fit in, also where rows have no id; another shard moves few rows."""
    docs = [(None if i % 3 else i, f"text {i % 7}") for i in range(400)]
    got = sharding.place(frame(spark, docs), scratch, shards=8, vnodes=16, deal=4).collect()
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"]].add(r["shard"])
    assert sorted(Counter(r["shard"] for r in got).values()) == [50] * 8 and sum(map(len, of.values())) <= 7 + 8
    docs = frame(spark, [(i, f"text {i}") for i in range(900)])
    was, now = ({r["doc_id"]: r["shard"] for r in sharding.place(docs, scratch, shards=n).collect()} for n in (8, 9))
    assert sum(was[i] != now[i] for i in was) < 0.45 * len(was)


def plain_walk(counts, owners, shards):
    """One row at a time: first into the owner of its arc, then, in ring order, clockwise to the next shard with room."""
    total = sum(counts.values())
    room, out, over = [total // shards + (s < total % shards) for s in range(shards)], Counter(), []
    for arc, shard in enumerate(owners):
        for _ in range(counts.get(arc, 0)):
            if room[shard]:
                room[shard] -= 1
                out[arc, shard] += 1
            else:
                over.append(arc)
    for arc in over:
        at = next(a for d in range(1, len(owners) + 1) if room[owners[a := (arc + d) % len(owners)]])
        room[owners[at]] -= 1
        out[arc, owners[at]] += 1
    return out


@given(st.lists(st.integers(0, 30), min_size=12, max_size=12), st.lists(st.integers(0, 3), min_size=12, max_size=12))
@settings(max_examples=100, deadline=None)
def test_ring_equals_one_row_at_a_time(counts, owners):
    owners = [*owners, 0, 1, 2, 3]
    got = Counter()
    for arc, a, b, shard, _ in sharding.walk(dict(enumerate(counts)), owners, 4):
        got[arc, shard] += b - a
    assert got == plain_walk(dict(enumerate(counts)), owners, 4)


# --- 10 ------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="main"><article><h1>Head &amp; line</h1><p><b>First<br>para.<p>Second&nbsp; <a href=x>link</a>&hellip;
<ul><li>one<li>two</ul><script>var t="</p>";</script><form><input>send</form><aside>side</aside><div class="ad">Buy</div>
<section class="comments"><p>me too</p></section></article></div><footer>&copy; us</footer></body></html>"""


def test_html_structure():
    assert html.read(PAGE)[0] == "Head & line\nFirst para.\nSecond link…\none\ntwo"
    attributes = '<p title="the hidden id=ad role" data-id="ad">Kept</p><article class="comment">No</article><div class="overflow-hidden">Too</div><p hidden>No</p>'
    assert html.read(attributes)[0] == "Kept\nToo"
    assert html.read("")[0] == "" and html.read("plain < text")[0] == "plain < text"
    assert html.read("<p>a" * 3000)[0].count("\n") == 2999


def test_html_names_and_teasers():
    page = """<div id="share-prices"><p>Prices fell</p></div><div class="search-results-story"><p>Found</p></div><div class="share-box">Tell</div>
    <div class="col ad-slot-2">Buy</div><div class="comment-body">me</div><p>super<wbr>cali<img src=x>fragil<br>istic</p><article class="x"><a>Teaser</a></article>"""
    # a name that could be a story's deletes nothing on a page alone
    assert html.read(page)[0] == "Prices fell\nFound\nTell\nsupercalifragil istic\nTeaser"
    assert html.read("<p>By the way</p><article><p>A long story that is the page</p></article>")[0] == "By the way\nA long story that is the page"
    for name in ('id="comment-on-budget"', 'class="cookie-recipe"', 'class="ad-hoc-report"', 'class="market-alerts"', 'class="search"', 'class="footer-notes"', 'class="story social"', 'id="share-prices"'):
        assert html.read(f"<div {name}><p>All of it</p></div>")[0] == "All of it", name


def test_extraction_of_built_pages(spark, scratch):
    """Pages built of known blocks: the article's blocks come back, in order, and nothing else."""
    r, pages, want = random.Random(8), [], {}
    words = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet über naïve".split()) + str(r.randrange(999)) for _ in range(n))
    for i in range(120):
        host = f"h{i % 4}.example"
        blocks = [words(r.randint(3, 30)) for _ in range(r.randint(1, 6))]
        tags = [r.choice(("p", "h2", "blockquote", "li")) for _ in blocks]
        body = "".join(f"<{t}>{b.replace(' ', r.choice((' ', chr(10), '  <i></i>')))}{r.choice(('', f'</{t}>'))}" if t != "li" else f"<ul><li>{b}</ul>" for t, b in zip(tags, blocks, strict=True))
        top = f"<div class=brand><p>Welcome to {host}</p><p>Since 1999</p></div>"  # on all pages of the host, under no telling name
        wrap = r.choice(("<article>{}</article>", "<div id=x{i}>{}</div>", "<main><div>{}</div></main>")).replace("{i}", str(i))
        pages.append((i, f"https://{host}/{i}", f"<html><head><title>t</title></head><body><nav>Menu {i}</nav>{top}{wrap.format(body)}<div class='promo'>{words(5)}</div><footer>{i}</footer>"))
        want[i] = "\n".join(blocks)
    df = spark.createDataFrame([(*p, "x", 1, "y") for p in pages], "page_id long, url string, html string, host string, template int, t_host string")
    got = {q["page_id"]: q["text"] for q in html.main_text(df, scratch).collect()}
    assert got == want
    twice = html.main_text(df.unionByName(df), scratch).collect()
    assert Counter((q["page_id"], q["text"]) for q in twice) == Counter(list(want.items()) * 2)


def test_site_templates(spark, scratch):
    pages = [(i, f"https://one.example/{i}", f"<body><div class=top><p>Welcome to the site</p></div><div><p>Story {i}</p><p>Quote</p></div><div><p>All rights</p></div></body>" if i % 2 else f"<div class=top><p>Welcome to the site</p></div><div><p>Story {i}</p></div><div><p>All rights</p></div>") for i in range(12)]
    pages += [(20 + i, "https://two.example/x", "<p>Only page</p>") for i in range(9)] + [(40, None, "<p>x</p>"), (41, "https://one.example/z", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.main_text(df, scratch).collect()}
    assert got[2]["text"] == "Story 2" and got[25]["text"] == "Only page" and got[40]["text"] == "x" and got[41]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == len(pages)
    assert html.main_text(df.limit(0), scratch).count() == 0


# --- hashes --------------------------------------------------------------------------------
def thue_morse(n):
    word, other = "a", "b"
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


def test_mirrored_words_have_hashes_of_their_own(spark, scratch):
    """Words that any polynomial modulo a power of two confuses."""
    from sparkwire.llm.wordhash import slices

    for n in (8, 64, 256, 512, 1024, 8192):
        pair = pa.array(list(thue_morse(n)))
        [(_, _, t)] = slices(pair, lower=True)
        assert len(set(t.words().tolist())) == 2
    one, two = thue_morse(1024)
    docs = [(1, f"one two {one}"), (2, f"one two {two}"), (3, f"one two {one}")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, docs), scratch, minhash.Near(shingle=3, similar=85)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    [line] = quality.measure(pa.array([f"{one}\n{two}\n"], pa.string())).column("n_dup_lines").to_pylist()
    assert line == 0
    known = {r["doc_id"]: r["n_known"] for r in lm.score(frame(spark, [(5, two)]), lm.train(frame(spark, [(4, one)]), scratch, least=1)).collect()}
    assert known == {5: 1}  # the end alone


def test_spans_are_told_by_their_bytes_alone():
    from sparkwire.llm.wordhash import slices

    r = random.Random(6)
    texts = [" ".join("".join(r.choices("abé字", k=r.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(20)) for _ in range(40)]
    seen = {}
    for _, _, t in slices(pa.array(texts * 2), lower=True, most_bytes=5000):
        for h, a, b in zip(t.words().tolist(), t.starts, t.ends, strict=True):
            assert seen.setdefault(h, t.data[a:b].tobytes()) == t.data[a:b].tobytes()
    assert len(seen) == len({w.encode() for x in texts for w in x.split(" ")})
