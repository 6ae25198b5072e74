"""Merkle fingerprints: trees, edits, likeness, and the whole query against a plain version."""

import random
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwire.llm import merkle
from sparkwire.llm.queries import queries
from sparkwire.llm.scratch import Scratch

TEXT = st.lists(st.sampled_from(["a", "b. ", "c! d", "\n", "\n\n", "# head\n", "é🚀", " ", "word " * 80, "x" * 300, ". . ", "?\n", "\r\n", " "]), max_size=25).map("".join)
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_pieces_are_the_text(text):
    t = merkle.Tree(text)
    assert t.piece_ends == sorted(set(t.piece_ends)) and (t.piece_ends[-1:] or [0])[0] == len(text)
    assert t.paragraph_ends == sorted(set(t.paragraph_ends)) and (t.paragraph_ends[-1:] or [0])[0] == len(t.pieces)
    assert t.section_ends == sorted(set(t.section_ends)) and (t.section_ends[-1:] or [0])[0] == len(t.paragraphs)
    assert len(t.paragraphs) == text.count("\n") + (text[-1:] not in ("", "\n"))


@given(TEXT, TEXT)
@settings(max_examples=300, deadline=None)
def test_roots_and_likeness(a, b):
    f, g = merkle.fingerprint(a), merkle.fingerprint(b)
    assert (f == g) == (a == b) == (merkle.likeness(f, g) == 1.0)
    assert 0 <= merkle.likeness(f, g) == merkle.likeness(g, f) <= 1
    assert merkle.likeness(f, f) == 1.0


@given(TEXT, TEXT)
@settings(max_examples=300, deadline=None)
def test_edits_rebuild_the_other_text(a, b):
    """What lies outside the edits is equal, so putting the other side's spans in gives the other text."""
    out, at = [], 0
    for s, t, u, v in merkle.edits(merkle.Tree(a), merkle.Tree(b)):
        out += [a[at:s], b[u:v]]
        at = t
    assert "".join([*out, a[at:]]) == b


def test_edits_are_local():
    text = "".join(f"Line {i} says this. And it says that {i * i}! End {i % 3}.\n" + "\n" * (i % 7 == 0) for i in range(400))
    at = text.index("Line 200")
    changed = text[:at] + "Now " + text[at:].replace("that 40000", "that 40001", 1)
    spans = merkle.edits(merkle.Tree(text), merkle.Tree(changed))
    assert 1 <= len(spans) <= 2 and sum(t - s for s, t, _, _ in spans) < 80 and spans[0][0] <= at < spans[0][1]
    like = merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(changed))
    assert 0.99 < like < 1
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint("Nothing of it. At all.\n" * 90)) == 0


def test_long_and_empty():
    assert merkle.fingerprint(None) == merkle.fingerprint("") and merkle.fingerprint("").endswith(":")
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("x")) == 0
    assert len(merkle.Tree("some words without an end " * 100000).pieces) >= 1
    assert len(merkle.Tree("y" * 3000000).pieces) == 1
    assert len(merkle.Tree("." * 100000 + "\n" * 100000).paragraphs) == 100000


def plain(docs):
    ordered = sorted(docs)
    out = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        f, g, h = (merkle.fingerprint(x) for x in (text, edited, after))
        out.append((i, len(text), sha256(edited.encode()).hexdigest(), f, g, merkle.likeness(f, g), merkle.likeness(f, h)))
    return sorted(out)


def texts(n=300, seed=2):
    r = random.Random(seed)
    words = ["One. ", "two ", "three! ", "é ", "🚀", "\n", "\n\n", "four? ", "x" * 50]
    return ["".join(r.choices(words, k=r.choice([0, 1, 5, 60, 300]))) for _ in range(n)]


def test_documents(spark):
    docs = [(3 * i - 50, t) for i, t in enumerate(texts())] + [(10**9, "same. ") , (10**9, "same. "), (10**9, "same. ")]
    df = spark.createDataFrame([(i, t or None, 1, "clash", 2) for i, t in docs], "doc_id long, text string, part int, h string, kind int").repartition(5)
    for partitions in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = merkle.fingerprints(df, Scratch(spark, "t")).select(COLUMNS).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert sorted(map(tuple, got)) == plain(docs)


def test_small_tables(spark):
    kind = "doc_id long, text string"
    assert merkle.fingerprints(spark.createDataFrame([], kind), Scratch(spark, "t")).collect() == []
    alone = merkle.fingerprints(spark.createDataFrame([(4, "abcd. ef")], kind), Scratch(spark, "t")).select(COLUMNS).collect()
    assert [tuple(r) for r in alone] == plain([(4, "abcd. ef")]) and alone[0]["near_next"] == 1.0
    rows = merkle.fingerprints(spark.createDataFrame([(None, "b. c"), (None, None), (None, "b. c"), (1, "z")], kind), Scratch(spark, "t")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "None", "None", "None"]


def test_query(spark, tmp_path):
    docs = list(enumerate([*texts(60, 9), "long text. " * 50000]))
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["op13_merkle_fingerprints"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == plain(docs)
    for r in got.collect():
        assert (r["edit_from"] is None) == (r["near_edited"] == 1.0)
        if r["edit_from"] is not None:
            assert 0 <= r["edit_from"] <= r["edit_to"] <= r["n_chars"]
