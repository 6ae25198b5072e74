"""Streaming forms of deduplication; extensions, as the batch operators are what has to be matched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwire.operators.dedup import first_wins, unknown


def same_headline_within_week(stream: DataFrame, key: str = "title_fingerprint", time: str = "discovered_at") -> DataFrame:
    """The first row of each headline; state is dropped by the watermark a week later."""
    return stream.withWatermark(time, "7 days").dropDuplicatesWithinWatermark([key])


def append_new(stream: DataFrame, store_path: str, checkpoint: str, key: str, *order: str) -> Callable:
    """A query that appends rows with new keys to a Parquet store, batch by batch, and ends when all input is read."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        fresh = first_wins(df, key, *order)
        path = spark._jvm.org.apache.hadoop.fs.Path(store_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            # a batch that is run again finds its own rows, and adds none
            fresh = unknown(fresh, spark.read.schema(df.schema).parquet(store_path), key)
        fresh.write.mode("append").parquet(store_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def late_rows(stream: DataFrame, now: str, hours: int, time: str = "published_at") -> tuple[DataFrame, DataFrame]:
    """(fresh, late): a watermark alone would drop the late ones without a count."""
    cutoff = F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours")
    fresh = F.coalesce(F.col(time) >= cutoff, F.lit(False))
    return stream.where(fresh), stream.where(~fresh)


def watched_late(stream: DataFrame, now: str, hours: int, time: str = "published_at", name: str = "freshness") -> DataFrame:
    """The fresh rows of a stream. How many are dropped as ``too_old`` or ``undated``, and how many there were, is told by the progress of each
    micro-batch (``observedMetrics``), in the pass that drops them."""
    cutoff = F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours")
    seen = stream.observe(name, F.count("*").alias("fetched"), F.count_if(F.col(time) < cutoff).alias("too_old"), F.count_if(F.col(time).isNull()).alias("undated"))
    return seen.where(F.col(time) >= cutoff)
