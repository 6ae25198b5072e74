"""Duplicates: within a feed, across feeds, against the store, and the same story within a week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwire.vocab import SAME_STORY_DAYS


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in ``order``.

    A minimum over the order and the row merges on the map side, so a key that holds much of the
    table does not meet in one task, as it would in a window.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    pick = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row")
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(pick)
    return out.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def unknown(df: DataFrame, store: DataFrame, key: str = "url_hash") -> DataFrame:
    """Rows whose key is not in the store. The store's keys are broadcast only below Spark's size limit."""
    return df.join(store.select(key), key, "left_anti")


def known(df: DataFrame, store: DataFrame, key: str = "url_hash") -> DataFrame:
    return df.join(store.select(key), key, "left_semi")


def conflicts(df: DataFrame, store: DataFrame) -> DataFrame:
    """The stored id and status a row conflicts with, by either unique key; the hash's match first."""
    by_hash = store.select(F.col("url_hash"), F.struct("id", "status").alias("_h"))
    by_url = store.select(F.col("canonical_url"), F.struct("id", "status").alias("_u"))
    hit = F.coalesce("_h", "_u")
    out = df.join(by_hash, "url_hash", "left").join(by_url, "canonical_url", "left")
    return out.withColumns({"duplicate_of": hit["id"], "duplicate_status": hit["status"], "is_new": hit.isNull()}).drop("_h", "_u")


def same_story(df: DataFrame, id_col: str = "id", key: str = "title_fingerprint", time: str = "discovered_at", days: int = SAME_STORY_DAYS) -> DataFrame:
    """``twin_of``: the least earlier id with the same fingerprint, found up to ``days`` before, inclusive.

    Twins that were themselves refused count. Work is a range frame per fingerprint, linear in its rows.
    """
    seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy(seconds).rangeBetween(-days * 86400, Window.currentRow)
    least = F.min(id_col).over(frame)
    told = df.where(F.col(key).isNotNull()).withColumn("twin_of", F.when(least < F.col(id_col), least))
    # headlines without a fingerprint have no twin, and would meet in one task
    return told.unionByName(df.where(F.col(key).isNull()).withColumn("twin_of", F.lit(None).cast(df.schema[id_col].dataType)))


def registered(df: DataFrame, store: DataFrame, next_id: int, *order: str) -> DataFrame:
    """Rows to append: not in the store by either key, once each, with dense ids from ``next_id`` in order.

    Only new rows of one run come here, which the run's limit bounds.
    """
    fresh = unknown(unknown(df, store, "url_hash"), store, "canonical_url")
    fresh = first_wins(fresh, "url_hash", *order)
    return fresh.withColumn("id", (F.row_number().over(Window.orderBy(*order)) + (next_id - 1)).cast("long"))


def with_default(df: DataFrame, answers: DataFrame, key: str, default: Column, value: str = "answer") -> DataFrame:
    """Recorded answers by key, with a default where none is recorded."""
    return df.join(answers.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))
