"""Freshness, the funnel of a run, fair order across sources, and the run's limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwire.operators.scan import running


def is_fresh(published: Column, cutoff: Column) -> Column:
    return F.coalesce(published >= cutoff, F.lit(False))


def funnel(published: Column, cutoff: Column, is_known: Column) -> Column:
    """The first class that fits: undated, too_old, duplicate, fresh."""
    return (
        F.when(published.isNull(), "undated").when(~is_fresh(published, cutoff), "too_old").when(is_known, "duplicate").otherwise("fresh")
    )


def round_robin(df: DataFrame, source: str, time: Column, *ties: str) -> DataFrame:
    """``round`` (from 1) and ``place``, the newest time of the source: order by round, time desc, place, ties.

    Round k holds the k-th newest of each source.
    """
    by_time = Window.partitionBy(source).orderBy(time.desc(), *ties)
    return df.withColumn("round", F.row_number().over(by_time).cast("long"))


def work_list(df: DataFrame, source: str, time: Column, *ties: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in fair order, with their position. At most ``limit`` rows of a source can be among
    them, so longer sources are cut by rank before anything is put in order."""
    ranked = round_robin(df, source, time, *ties).where(F.col("round") <= limit)
    top = ranked.orderBy("round", time.desc(), *ties).limit(limit)
    whole = Window.orderBy("round", time.desc(), *ties)  # at most ``limit`` rows
    return top.withColumn("position", F.row_number().over(whole).cast("long"))


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """``name``: the place of each row in the whole order, by range partitions."""
    return running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + first)


def used_before(work: DataFrame, order: list[Column], consumes: Column) -> DataFrame:
    """``used``: how many rows before each one use up the run's limit; the list may be of any length."""
    return running(work, order, {"used": F.when(consumes, 1).otherwise(0).cast("long")})


def within_limit(work: DataFrame, order: str, consumes: Column, limit: int) -> DataFrame:
    """Rows of a run's work list up to the row with which ``limit`` rows have been worked on; refused twins use no
    room, and what lies beyond is left for the next run."""
    return used_before(work, [F.col(order)], consumes).where(F.col("used") < limit).drop("used")


def first_outage(work: DataFrame, order: Column, outage: Column) -> DataFrame:
    """``work`` with ``_first``, the order's value at the first outage: one aggregate, and one row brought to all."""
    first = work.agg(F.min(F.when(outage, order)).alias("_first"))
    return work.crossJoin(F.broadcast(first))  # one row


def until_outage(work: DataFrame, order: str, outage: Column, needs_answer: Column, is_new: Column) -> DataFrame:
    """``fate`` of each row of a run: the first outage returns its row; after it, resumed rows that
    need an answer are skipped, new rows are not registered, and others go on."""
    first = F.col("_first")
    after = F.coalesce(F.col(order) > first, F.lit(False))
    fate = (
        F.when(F.coalesce(F.col(order) == first, F.lit(False)), "returned")
        .when(after & is_new, "not_registered")
        .when(after & needs_answer, "skipped")
        .otherwise("worked")
    )
    return first_outage(work, F.col(order), outage).withColumn("fate", fate).drop("_first")


def run_list(resumed: DataFrame, fresh: DataFrame, source: str, time: str, *ties: str) -> DataFrame:
    """Resumed work first, the newest before older, then fresh articles in fair order: rows of both with ``is_new`` and ``place``, a struct to sort by.

    Both need the ``ties``, which end the order.
    """
    newest = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    zero = F.lit(0).cast("long")
    again = resumed.withColumns({"is_new": F.lit(False), "place": F.struct(zero.alias("part"), zero.alias("round"), newest(time).alias("newest"), *ties)})
    fair = round_robin(fresh, source, F.col(time), *ties)
    fair = fair.withColumns({"is_new": F.lit(True), "place": F.struct(F.lit(1).cast("long").alias("part"), "round", newest(time).alias("newest"), *ties)}).drop("round")
    return again.unionByName(fair, allowMissingColumns=True)


def run_fates(work: DataFrame, limit: int, outage: Column, needs_answer: Column, is_duplicate: Column, is_twin: Column) -> DataFrame:
    """``used`` and ``fate`` of every row of a run's list (``place``, ``is_new``, as from :func:`run_list`), of any length.

    ``worked``: taken up, and counted to the limit. ``returned``: the provider's first outage hit it, it goes back and counts. After that no new row is registered
    (``not_registered``) and resumed rows that need an answer are ``skipped``, but others go on. ``duplicate`` and ``same_story`` rows use no room.
    With the limit used up the rest waits for the ``next_run``, an outage that lies there included.
    """
    new, place, first = F.col("is_new"), F.col("place"), F.col("_first")
    yes = lambda c: F.coalesce(c, F.lit(False))
    free = new & (yes(is_duplicate) | yes(is_twin))
    rows = first_outage(work, place, yes(outage) & yes(needs_answer) & ~free)
    after = yes(place > first)
    stopped = after & (new | yes(needs_answer))
    rows = used_before(rows, [place], ~free & ~stopped)
    fate = (
        F.when(F.col("used") >= limit, "next_run").when(yes(place == first), "returned").when(after & new, "not_registered").when(stopped, "skipped")
        .when(new & yes(is_duplicate), "duplicate").when(new & yes(is_twin), "same_story").otherwise("worked")
    )
    return rows.withColumn("fate", fate).drop("_first")


def chosen(df: DataFrame, wanted: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows that were asked for, ids asked for that are no candidates)."""
    return df.join(wanted, key, "left_semi"), wanted.join(df.select(key), key, "left_anti")
