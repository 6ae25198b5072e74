"""The pipeline against a plain version of all its stages, on a small folder of documents; empty tables and clashing columns."""

from collections import Counter

import duckdb

import corpus_pipeline
from sparkwire.llm import quality, tokenids
from sparkwire.llm.queries import oracle_sql, queries, tokenizer_path
from tests.llm import brute
from tests.llm.test_operators import corpus

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_run(spark, tmp_path):
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in corpus(seed=9)]
    spark.createDataFrame(docs, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [d for d in docs if brute.kept(d[1], quality.Bands())]
    assert 0 < len(good) < len(docs)
    component = brute.near([(d[0], d[1]) for d in good], 5, 80)
    left = [d for d in good if component[d[0]] == d[0]]
    assert len(left) < len(good)
    # the mix by its SQL
    spark.createDataFrame(left, KIND).write.parquet(str(tmp_path / "left"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/left/*.parquet'")
    r = con.execute(oracle_sql()["op8_source_mixing"])
    names = [x[0] for x in r.description]
    times = {x["doc_id"]: x["taken"] // x["size"] for x in (dict(zip(names, y, strict=True)) for y in r.fetchall())}
    e = tokenids.encoder(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for d in left:
        n = len(e.whole(d[1])) + 1
        for k, start in enumerate(range(0, n, 4096)):
            if times[d[0]]:
                want[d[0], k, min(4096, n - start)] += times[d[0]]
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == len(brute.best_fit([r["length"] for r in got], 4096))


def test_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with the operators' own names; then no rows at all."""
    texts = [t for _, t in corpus(seed=4)]
    rows = [(i if i % 17 else None, t, None, None if i % 5 else "s", None, "a", i, "b", 1.0, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:9], KIND + ", row string, hash long, kept string, size double, key string")
    path = str(tmp_path / "odd")
    df.write.parquet(f"{path}/documents.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == df.columns and docs.count() > 0, name
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert packed.count() >= docs.count() > 0
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_registered():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(oracle_sql()) <= set(queries())
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None
