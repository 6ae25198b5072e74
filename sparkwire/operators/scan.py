"""Running sums over a long ordered list or many, by range partitions and the sums of each partition.

A window over the whole list would put it into one task. Here rows are dealt out by ranges of the order, summed up
partition by partition, and each partition then starts from the sum of those before it. A key's rows lie in one partition or
in a few adjacent ones, and only one key can cross a border, so the sums carried over are at most one row a partition.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pinned(df: DataFrame) -> DataFrame:
    """The rows as they are now, kept in the folder that ``spark.checkpoint.dir`` names; a folder of its own only where none is set, in a single process (tests)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="sparkwire-"))
    return df.checkpoint()


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], key: tuple[str, ...] = (), pin: Callable[[DataFrame], DataFrame] = pinned) -> DataFrame:
    """``df`` with a column for each of ``sums``: its sum over the rows of the key that come before the row (0 for the first).

    Rows that are equal in ``order`` come in any, but one fixed order; give an order that ends with a unique column where that matters.
    ``pin`` has to keep rows and columns as they are computed once, as the partition's number is one of them.
    """
    keys = [F.col(k) for k in key]
    rows = df.withColumns({f"_sum_{n}": v for n, v in sums.items()}).withColumn("_tie", F.monotonically_increasing_id())
    rows = pin(rows.repartitionByRange(*keys, *order, F.col("_tie")).withColumn("_part", F.spark_partition_id()))
    per = rows.groupBy(*keys, "_part").agg(*[F.sum(f"_sum_{n}").alias(f"_of_{n}") for n in sums])
    # one row a key and partition, so at most as many of one key as there are partitions
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_part").alias("_k_part"), *[F.sum(f"_of_{n}").over(before).alias(f"_before_{n}") for n in sums])
    carried = carried.where(" or ".join(f"_before_{n} is not null" for n in sums))
    same = F.col("_part") == F.col("_k_part")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # at most one key crosses a border of partitions: no more rows than partitions
    out = rows.join(F.broadcast(carried), same, "left")
    here = Window.partitionBy(*keys, "_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = out.withColumns({n: F.coalesce(F.sum(f"_sum_{n}").over(here), zero) + F.coalesce(F.col(f"_before_{n}"), zero) for n in sums})
    return out.select(*df.columns, *sums)
