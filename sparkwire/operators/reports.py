"""Counts, health, summaries and newest-first lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.operators.schedule import is_fresh


def status_counts(articles: DataFrame, status: str = "status") -> DataFrame:
    """(status, n, place): order by place for the order of the states; states without rows are left out."""
    place = F.array_position(F.array(*[F.lit(s) for s in vocab.STATUSES]), F.col(status))
    return articles.groupBy(status).agg(F.count("*").alias("n")).withColumn("place", place)


def posted_total(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count_if(F.col("status").isin(*vocab.POSTED)).alias("posted"))


def feed_health(feeds: DataFrame, items: DataFrame, cutoff: Column) -> DataFrame:
    """Per feed, those without items included: items, fresh items, newest; the error if its fetch failed."""
    per = items.groupBy("feed").agg(
        F.count("*").alias("items"), F.count_if(is_fresh(F.col("published_at"), cutoff)).alias("fresh"), F.max("published_at").alias("newest")
    )
    return feeds.join(per, "feed", "left").fillna({"items": 0, "fresh": 0})


def newest_first(articles: DataFrame, limit: int | None = None, *statuses: str) -> DataFrame:
    """A bounded list is a top-k per partition and a merge, never a full sort."""
    rows = articles.where(F.col("status").isin(*statuses)) if statuses else articles
    rows = rows.orderBy(F.coalesce("published_at", "discovered_at").desc(), F.col("id").desc())
    return rows if limit is None else rows.limit(limit)


def recent_runs(runs: DataFrame, limit: int = 5) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc()).limit(limit)


#: The counters of a run, in the order of its report.
COUNTERS = (
    "feeds_ok", "feeds_failed", "fetched", "too_old", "undated", "duplicates", "same_story", "analyzed", "approved", "rejected", "failed", "ready_for_review", "recovered", "resumed", "facebook_writes",
)


class Counters:
    """A run's counters, taken in the passes that write its tables: nothing is read twice to be counted."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def _watched(self, df: DataFrame, **metrics: Column) -> DataFrame:
        o = Observation()
        self._seen.append(o)
        return df.observe(o, *[m.alias(k) for k, m in metrics.items()])

    def feeds(self, health: DataFrame) -> DataFrame:
        return self._watched(health, feeds_ok=F.count_if(F.col("error").isNull()), feeds_failed=F.count_if(F.col("error").isNotNull()))

    def funnel(self, classes: DataFrame) -> DataFrame:
        of = lambda k: F.count_if(F.col("class") == k)
        return self._watched(classes, fetched=F.count("*"), too_old=of("too_old"), undated=of("undated"), duplicates=of("duplicate"))

    def articles(self, judged: DataFrame) -> DataFrame:
        answered = F.coalesce(F.col("outcome").isin("approved", "rejected"), F.lit(False))
        twin, s = F.col("twin_of").isNotNull(), F.col("status")
        return self._watched(
            judged, same_story=F.count_if(twin), analyzed=F.count_if(answered), approved=F.count_if(answered & (F.col("outcome") == "approved")), rejected=F.count_if(answered & (F.col("outcome") == "rejected")),
            failed=F.count_if(s == "FAILED"), ready_for_review=F.count_if(s == "READY_FOR_REVIEW"), resumed=F.count_if(~F.col("is_new")),
        )

    def values(self, **known: int) -> dict[str, int]:
        """All counters once the watched tables are written; those that no pass counts are given."""
        got = {k: v for o in self._seen for k, v in o.get.items()} | known
        return {k: int(got.get(k, 0) or 0) for k in COUNTERS}


def audit_trail(events: DataFrame, article_id: int) -> DataFrame:
    return events.where(F.col("article_id") == article_id).orderBy("event_id")


def format_summary(row: dict) -> str:
    """The console block of a run, from its one-row summary."""
    return "\n".join(["-" * 50, *(f"  {k.replace('_', ' ')}: {v}" for k, v in row.items()), "-" * 50])
