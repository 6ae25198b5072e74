"""Article state as an append-only event log, folded into a current view; budgets, recovery and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.operators.fold import replay

EVENT = "event_id long, article_id long, run_id string, from_status string, to_status string, stage string, note string, created_at timestamp"


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.TRANSITIONS), "allowed_from string, allowed_to string, allowed_stage string")


def latest(events: DataFrame, article: str = "article_id", order: str = "event_id", *columns: str) -> DataFrame:
    """The last event of each article; merged on the map side, without a sort."""
    columns = columns or tuple(c for c in events.columns if c != article)
    return events.groupBy(article).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_e")).select(article, "_e.*")


def resets_budget(from_status: Column, to_status: Column) -> Column:
    return to_status.isin(*vocab.RESETS_BUDGET) & ~F.coalesce(from_status == "FAILED", F.lit(False))


def retry_counts(events: DataFrame, article: str = "article_id", order: str = "event_id") -> DataFrame:
    """Failures since the last event that reset the budget, by two aggregations and no window."""
    reset = resets_budget(F.col("from_status"), F.col("to_status"))
    last = events.groupBy(article).agg(F.max(F.when(reset, F.col(order))).alias("reset_at"))
    failed = events.where("to_status = 'FAILED'").join(last, article)
    counts = failed.where(F.col("reset_at").isNull() | (F.col(order) > F.col("reset_at"))).groupBy(article).agg(F.count("*").alias("n"))
    return last.join(counts, article, "left").select(article, F.coalesce("n", F.lit(0)).alias("retry_count"))


def chained(events: DataFrame, article: str = "article_id", order: str = "event_id", status: str = "to_status") -> DataFrame:
    """Each event with the status and stage before it."""
    w = Window.partitionBy(article).orderBy(order)
    out = events.withColumn("before", F.lag(status).over(w))
    return out.withColumn("stage_before", F.lag("stage").over(w)) if "stage" in events.columns else out


def is_allowed(before: Column, after: Column, failed_stage: Column) -> Column:
    """The transition relation as an expression: no join is needed for twenty pairs."""
    pair = F.concat_ws(">", before, after)
    plain = [f"{a}>{b}" for a, b, s in vocab.TRANSITIONS if s is None]
    resume = F.lit(False)
    for a, b, s in vocab.TRANSITIONS:
        if s is not None:
            resume = resume | ((pair == f"{a}>{b}") & F.coalesce(failed_stage == s, F.lit(False)))
    return F.when(before.isNull(), after == "DISCOVERED").otherwise(pair.isin(*plain) | resume)


def invalid(events: DataFrame, article: str = "article_id", order: str = "event_id") -> DataFrame:
    c = chained(events, article, order)
    return c.where(~is_allowed(F.col("before"), F.col("to_status"), F.col("stage_before")))


def lost_updates(events: DataFrame) -> DataFrame:
    """Compare-and-set losers: refused events that name another state than the one they met."""
    lost = replay(events).where(~F.col("accepted") & F.col("from_status").isNotNull())
    return lost.where(~F.col("from_status").eqNullSafe(F.col("before")))


def folded(events: DataFrame, article: str = "article_id", order: str = "event_id", **options) -> DataFrame:
    """(article, status, error_stage, retry_count) after the accepted events of a log that may hold refused ones."""
    held = replay(events, article, (order,), **options).where("accepted")
    held = held.select(article, order, F.col("before").alias("from_status"), F.col("after").alias("to_status"), F.col("stage_after").alias("error_stage"))
    now = latest(held, article, order, "to_status", "error_stage").withColumnRenamed("to_status", "status")
    return now.join(retry_counts(held, article, order), article)


def failed(article: Column, stage: Column, error: Column) -> Column:
    from sparkwire.functions.text import short_error

    return F.struct(article.alias("article_id"), F.lit("FAILED").alias("to_status"), stage.alias("stage"), short_error(error, vocab.MAX_ERROR_CHARS).alias("note"))


def recovered(current: DataFrame) -> DataFrame:
    """What a new run makes of interrupted work."""
    s = F.col("status")
    to = F.when(s == "ANALYZING", "DISCOVERED").when(s == "PUBLISHING", "FAILED").otherwise(s)
    return current.withColumns({
        "error_stage": F.when(s == "PUBLISHING", "publish_unknown").otherwise(F.col("error_stage")),
        "recovered": s.isin("ANALYZING", "PUBLISHING"),
        "status": to,
    })


def resolved(current: DataFrame, article_id: int, post_id: str | None) -> DataFrame:
    """A person's decision on an unknown outcome: the post's id, or that nothing was posted."""
    hit = (F.col("id") == article_id) & (F.col("status") == "FAILED") & (F.col("error_stage") == "publish_unknown")
    if post_id is not None:
        return current.withColumns({
            "status": F.when(hit, "POST_CREATED").otherwise(F.col("status")),
            "facebook_post_id": F.when(hit, post_id).otherwise(F.col("facebook_post_id")),
            "error_stage": F.when(~hit, F.col("error_stage")),
        })
    return current.withColumn("error_stage", F.when(hit, "publish_photo").otherwise(F.col("error_stage")))


def upgraded(articles: DataFrame) -> DataFrame:
    """Rows of the first schema version with their categories mapped to today's five; ids stay."""
    from sparkwire.functions.text import category

    return articles.withColumn("category", category(F.col("category")))


# --- predicates on the current view ------------------------------------------------


def resumable(retries: int) -> Column:
    s = F.col("status")
    again = (s == "FAILED") & F.col("error_stage").isin("analyze", "image") & (F.col("retry_count") < retries)
    return s.isin("DISCOVERED", "APPROVED", "IMAGE_CREATED") | F.coalesce(again, F.lit(False))


def publishable(retries: int) -> Column:
    s = F.col("status")
    again = (s == "FAILED") & (F.col("error_stage") == "publish_photo") & (F.col("retry_count") < retries)
    return F.col("facebook_photo_id").isNull() & F.col("facebook_post_id").isNull() & ((s == "READY_FOR_REVIEW") | F.coalesce(again, F.lit(False)))


def comment_pending(retries: int) -> Column:
    return F.col("status").isin("POST_CREATED", "COMMENT_PENDING") & F.col("facebook_comment_id").isNull() & (F.col("retry_count") < retries)


def unknown_outcome() -> Column:
    return (F.col("status") == "FAILED") & (F.col("error_stage") == "publish_unknown")


def needs_answer() -> Column:
    return (F.col("status") == "DISCOVERED") | ((F.col("status") == "FAILED") & (F.col("error_stage") == "analyze"))


def target() -> Column:
    return F.coalesce(F.nullif("facebook_post_id", F.lit("")), "facebook_photo_id")


def approved_content() -> Column:
    has = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("category", "catchy_headline", "facebook_caption")]
    return F.when(has[0] & has[1] & has[2], F.struct("category", "catchy_headline", "facebook_caption"))


# --- integrity ------------------------------------------------------------------------


def audit(articles: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(rule, violations): how many rows break each constraint. Row rules are one pass."""
    s = F.col("status")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    categories = F.col("category").isNotNull() & ~F.col("category").isin(*vocab.CATEGORY_ALIASES)
    rules = {
        "I2": ~s.isin(*vocab.STATUSES) | categories,
        "I3": s.isin(*vocab.NEEDS_CONTENT) & (empty("category") | empty("catchy_headline") | empty("facebook_caption")),
        "I4": s.isin(*vocab.NEEDS_IMAGE) & empty("image_path"),
        "I5": s.isin(*vocab.POSTED) & empty("facebook_photo_id") & empty("facebook_post_id"),
        "I6": (s == "PUBLISHED") & empty("facebook_comment_id"),
        "I7": (s == "PUBLISHING") & (~empty("facebook_photo_id") | ~empty("facebook_post_id")),
    }
    counts = articles.agg(*[F.count_if(F.coalesce(v, F.lit(True))).alias(k) for k, v in rules.items()])
    out = counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in rules]), F.array(*rules))).alias("rule", "violations"))
    for key in ("url_hash", "canonical_url"):
        again = articles.groupBy(key).count().where("count > 1")
        out = out.unionByName(again.agg(F.lit(f"I1_{key}").alias("rule"), F.count("*").alias("violations")))
    if events is not None:
        lost = events.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_anti")
        out = out.unionByName(lost.agg(F.lit("I8").alias("rule"), F.count("*").alias("violations")))
    return out
