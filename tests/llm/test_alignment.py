"""Cross-tokenizer alignment against a plain version over whole texts."""

import random
import re
from functools import partial

import pytest

from sparkwire.llm import alignment
from sparkwire.llm.queries import queries, tokenizer_path
from sparkwire.llm.scratch import Scratch
from tests.llm import plain_alignment as plain

PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
ODD = [
    None, "", " ", "  ", "\n", "\n\n  ", "a", " a", "a ", "a  b\n\n c\td ", "\nabc", "x;\r\ny", ")\r", " \r z", "a  b", "a  b", "   x", "　 y　", "▁", "a ▁ b", "q▁ w",
    "<s> x </s> <unk> <0x0A> <|endoftext|>", "\x00 z\x00", "\x1c \x1d a\x85 b", "日本 語　x", "é è ﬁ Ⅳ", "👩‍👩‍👧 emoji 🚀🚀", "a\tb\t\tc", "\f\v x\v", "don't we'll I'm", "aaaaaaaa" * 30, "0123456789" * 9, "é e", "​ a ​", "  a b",
    "the the the, there. The", "the cat", "x" * 5000 + " " * 300 + "y" * 100,
]


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = [" ", " ", "  ", "\n", "\t", "\r", "\r\n", " ", "　", "▁", "the", "and", "Xy", "é", "日本", ";", ")", "12", "'s", "\x1c", "\x85", "🚀", "<s>", "ing", "-", "▁▁"]
    return [*ODD, *["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(1500)]]


def test_segments_give_what_whole_texts_give(texts):
    p = alignment.pair(*PATHS)
    assert p.pattern is not None and not re.search(r"\\\r", p.pattern.pattern)
    for t in filter(None, texts):
        segments = p.segments(t)
        assert "".join(segments) == " " + t
        got, want = p.align(segments), plain.groups(t)
        if want is None:
            assert None in got, t
        else:
            assert ";".join(got) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want), t


def test_documents(spark, texts, monkeypatch):
    docs = [(i % 1400 if i % 9 else None, t) for i, t in enumerate(texts)] + [(7, "the cat")] * 3
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, block int").repartition(3)
    assert rows(alignment.align(df, Scratch(spark, "t"), *PATHS)) == sorted(plain.align(docs), key=repr)


def test_large_groups(spark, monkeypatch):
    """Groups with many links are summed up pair by pair, with the same result."""
    docs = [(i, t) for i, t in enumerate(["abcabc" * 400 + "é", "0" * 999, "x the y", "日本" * 50])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    p = alignment.pair(*PATHS)
    texts = alignment.pa.array([g for _, t in docs for g in p.align(p.segments(t))], alignment.pa.large_string())
    whole = alignment._Groups(texts)
    monkeypatch.setattr(alignment, "_MANY_LINKS", 1)
    split = alignment._Groups(texts)
    assert whole.pairs.tolist() == split.pairs.tolist() and whole.n_links.tolist() == split.n_links.tolist()
    totals = [[alignment.np.bincount(g.pair_of[lo:hi], g.times[lo:hi], len(g.pairs)).tolist() for lo, hi in zip(g.ends[:-1], g.ends[1:], strict=True)] for g in (whole, split)]
    assert totals[0] == totals[1] and max(split.times) > 1
    assert rows(alignment.align(df, Scratch(spark, "t"), *PATHS)) == sorted(plain.align(docs), key=repr)


def test_many_blocks(spark, texts):
    """Blocks of one document, too, and documents cut into several steps, count the same."""
    docs = [(i, t) for i, t in enumerate(texts[:80])]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    coded = list(alignment.pair(*PATHS).segments(t) for _, t in docs if t)
    assert len(coded) > 70
    one = rows(alignment.align(df, Scratch(spark, "t"), *PATHS))
    split = rows(alignment.align(df.repartition(40), Scratch(spark, "t"), *PATHS))
    assert one == split == sorted(plain.align(docs), key=repr)


def test_uncut_vocabularies():
    """Where a vocabulary has pieces across a space, whole texts are one segment."""
    assert alignment.cutter(True, ["▁a", "a▁b"]) is None
    assert alignment.cutter(False, ["▁a"]) is None
    assert "\\\n" not in alignment.cutter(True, ["▁a", "a\n"]).pattern
    assert "\\\n" in alignment.cutter(True, ["▁a", "\n"]).pattern


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(alignment.align(df, Scratch(spark, "t"), *PATHS)) == []


def test_query(spark, tmp_path):
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(["the cat sat", "the cat", None, "a very long text " * 5000])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    query = partial(queries()["op11_segment_alignment"], spark, str(tmp_path))
    assert rows(query()) == sorted(plain.align([(d[0], d[1]) for d in docs]), key=repr)
