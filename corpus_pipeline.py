"""The corpus pipeline: quality rules, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps with their columns, the last one
the packed pieces. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwire.llm import minhash, mixing, packing, quality
from sparkwire.llm.queries import tokenizer_path
from sparkwire.llm.scratch import Scratch, table_path


# Whatever other columns documents have, and whatever they are called, the first three stages give them back. Null and empty texts are judged
# (and dropped) by the first stage; rows without an id, and repeated rows, are documents like others but for near-dedup, where one id is one document;
# an empty table gives an empty one at every stage.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, Scratch(spark, "near-dedup"), minhash.Near(shingle=5, similar=80))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, Scratch(spark, "mixing"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, Scratch(spark, "packing"), tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express zstandard ratios or tokenizers; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
