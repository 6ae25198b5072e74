"""The publishing flow as a plan over tables: who may be published, what each recorded response leads to, and the log that tells it.

Ids of what was posted are rows of their own, before the status that they lead to: they alone keep an article from being posted twice.
Responses are a table (id, photo, photo_id, post_id, lookup, lookup_id, comment, comment_id) with outcome classes of
:func:`sparkwire.operators.publish.classify_response`; a missing one means that the request was not sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire.operators import publish, schedule, state

STEPS = "article_id long, step int, from_status string, to_status string, stage string, note string"


def external_ids(ids: DataFrame) -> DataFrame:
    """(article_id, photo_id, post_id): the first that were recorded; later ones never replace them."""
    told = ids.where(F.col("photo_id").isNotNull() | F.col("post_id").isNotNull())
    return told.groupBy("article_id").agg(F.min_by(F.struct("photo_id", "post_id"), F.struct("at", "step")).alias("_i")).select("article_id", "_i.*")


def candidates(current: DataFrame, now: str, hours: int, limit: int, retries: int, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows to publish, ids that were asked for and are none): posts that lack their comment first, by id, then the newest articles. ``wanted`` (id) is a person's choice,
    whatever the age; without it only fresh ones count. The limit holds for new posts."""
    pending = current.where(state.comment_pending(retries)).select("*", F.lit("comment").alias("kind"), F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("newest"), F.col("id")).alias("place"))
    ready, missing = current.where(state.publishable(retries)), None
    if wanted is not None:
        ready, missing = schedule.chosen(ready, wanted)
    else:
        ready = ready.where(schedule.is_fresh(F.col("published_at"), F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours")))
    newest = -F.unix_micros(F.coalesce("published_at", "discovered_at").cast("timestamp"))
    ready = ready.select("*", F.lit("photo").alias("kind"), F.struct(F.lit(1).alias("part"), newest.alias("newest"), (-F.col("id")).alias("id")).alias("place"))
    return pending.unionByName(ready.orderBy("place").limit(limit)), missing


def flow(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """What became of each candidate (id, status, error_stage, kind, place): ``attempted``, its new ``status`` and ``error_stage``, ids, ``writes``, and the ``path`` of its states.

    The first response after which more requests are pointless or risky ends the run: what comes later in order is not attempted. An earlier comment whose
    outcome is unknown is looked for before it is sent again; if that fails, the article stays as it is."""
    told = rows.withColumnsRenamed({"status": "was", "error_stage": "stage_was"}).join(responses.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id")
    outcome = lambda c: F.coalesce(F.col(c), F.lit("not_sent"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    photo = F.col("kind") == "photo"
    posted = photo & (outcome("photo") == "ok")
    asks = ~photo & yes(F.col("stage_was") == "comment_unknown")
    found = asks & (outcome("lookup") == "ok") & F.col("lookup_id").isNotNull()
    blind = asks & (outcome("lookup") != "ok")
    comments = posted | (~photo & ~found & ~blind)
    said = comments & (outcome("comment") == "ok")
    stops = lambda c: publish.stops_publishing(outcome(c))
    ends = (photo & ~posted & stops("photo")) | (blind & stops("lookup")) | (comments & ~said & stops("comment"))
    told = schedule.first_outage(told, F.col("place"), ends)
    attempted = F.col("_first").isNull() | (F.col("place") <= F.col("_first"))
    done = found | said
    status = F.when(~attempted | blind, F.col("was")).when(photo & ~posted, "FAILED").when(done, "PUBLISHED").otherwise("COMMENT_PENDING")
    stage = (
        F.when(~attempted | blind, F.col("stage_was")).when(photo & ~posted, F.when(outcome("photo") == "unknown", "publish_unknown").otherwise("publish_photo"))
        .when(~done, F.when(outcome("comment") == "unknown", "comment_unknown").otherwise("publish_comment"))
    )
    names = lambda *s: F.array(*map(F.lit, s))
    first = F.when(posted, names("PUBLISHING", "POST_CREATED")).when(photo, names("PUBLISHING", "FAILED")).otherwise(F.array().cast("array<string>"))
    after = F.when(found, names("PUBLISHED")).when(said, names("COMMENT_PENDING", "PUBLISHED")).when(comments, names("COMMENT_PENDING", "COMMENT_PENDING")).otherwise(F.array().cast("array<string>"))
    told = told.withColumns({
        "attempted": attempted, "status": status, "error_stage": stage, "path": F.when(attempted, F.concat(first, after)).otherwise(F.array().cast("array<string>")),
        "writes": F.when(attempted, posted.cast("int") + said.cast("int")).otherwise(0),
        "photo_id": F.when(attempted & posted, F.col("photo_id")), "post_id": F.when(attempted & posted, F.col("post_id")),
        "comment_id": F.when(attempted & done, F.when(found, F.col("lookup_id")).otherwise(F.col("comment_id"))),
    })
    return told.drop("_first")


def steps(done: DataFrame) -> DataFrame:
    """The events of a flow in order; a comment that is on its way is in doubt until its outcome is told."""
    each = done.select("id", "was", "error_stage", "path", F.posexplode("path").alias("k", "to_status"))
    last = F.col("k") == F.size("path") - 1
    flying = (F.col("to_status") == "COMMENT_PENDING") & ~last
    return each.select(
        F.col("id").cast("long").alias("article_id"), F.col("k").cast("int").alias("step"), F.when(F.col("k") == 0, F.col("was")).otherwise(F.get("path", F.col("k") - 1)).alias("from_status"), "to_status",
        F.when(flying, "comment_unknown").when(last, F.col("error_stage")).alias("stage"), F.when(flying, "comment request sent").alias("note"),
    )


def new_ids(done: DataFrame, at: Column) -> DataFrame:
    """(article_id, at, step, photo_id, post_id) of what was posted; to be committed before the events."""
    return done.where(F.col("photo_id").isNotNull() | F.col("post_id").isNotNull()).select(F.col("id").cast("long").alias("article_id"), at.alias("at"), F.lit(0).alias("step"), "photo_id", "post_id")
