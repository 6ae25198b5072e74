"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwire.llm import alignment, embeddings, html, lm, merkle, minhash, mixing, packing, prefixes, quality, records, sharding, urls
from sparkwire.llm.scratch import Scratch, table_path

URL_RULES = (
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on every machine; they are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, Scratch(spark, "op1"), minhash.Near(shingle=3, similar=85))


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"), Scratch(spark, "op2"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return records.encode(spark, docs, Scratch(spark, "op3"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), Scratch(spark, "op4"), URL_RULES)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return packing.pack(docs, Scratch(spark, "op5"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op6_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = lm.train(docs.where(~held_out), Scratch(spark, "op6"), least=1)
    return lm.score(docs, model, held_out=held_out)


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_read(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_read(spark, sf_dir, "pages"), Scratch(spark, "op10"))


def op11_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return alignment.align(docs, Scratch(spark, "op11"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(_read(spark, sf_dir, "conversations"), Scratch(spark, "op12"))


def op13_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_read(spark, sf_dir, "documents"), Scratch(spark, "op13"))


def oracle_sql() -> dict[str, str]:
    """No operator here is plain SQL but those that :mod:`sparkwire.llm.oracles` states."""
    from sparkwire.llm.oracles import SQL

    return SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))
