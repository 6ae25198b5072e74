"""A whole run: registry and documents in, funnel, unfinished work first and then fair order, limit, outage, registration, answers with one
correction, verdicts, cards, events out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.functions import text as X
from sparkwire.functions.layout import fit_headline
from sparkwire.operators import dedup, rules, schedule, state
from sparkwire.operators.scan import pinned
from sparkwire.sources import feeds as S


@dataclass(frozen=True)
class Run:
    articles: DataFrame  # those the run took up, new or resumed, with status, rule, outcome, twin_of, fate, card
    events: DataFrame  # the log to append
    classes: DataFrame  # the funnel class of every fetched article
    health: DataFrame  # a row per feed
    fates: DataFrame  # what became of every row of the work list


NO_ANSWER = (
    '{"is_relevant": false, "category": null, "catchy_headline": null, "facebook_caption": null, "original_url": null, '
    '"rejection_reason": "No recorded demo answer exists for this article."}'
)


def events_of(judged: DataFrame, run_id: str, now: str) -> DataFrame:
    """The events by which a run's articles reached their states. Those of a resumed article go on from its last step."""
    rows = judged.select("id", "path", "error_stage", F.coalesce("was", F.lit(None).cast("string")).alias("was"), F.coalesce("last_step", F.lit(-1)).alias("last_step"), "note")
    events = rows.select("id", "error_stage", "was", "last_step", "note", "path", F.posexplode("path").alias("k", "to_status"))
    back = F.when(F.col("k") == F.size("path") - 1, F.col("note"))
    return events.select(
        F.col("id").alias("article_id"), F.lit(run_id).alias("run_id"), F.when(F.col("k") == 0, F.col("was")).otherwise(F.get("path", F.col("k") - 1)).alias("from_status"), "to_status",
        F.when(F.col("to_status") == "FAILED", F.col("error_stage")).alias("stage"), (F.col("last_step") + 1 + F.col("k")).cast("int").alias("step"), F.to_timestamp(F.lit(now)).alias("created_at"), back.alias("note"),
    )


def with_correction(asked: DataFrame) -> DataFrame:
    """Verdicts of the answers; where the first one is invalid, that of the ``correction`` counts, the second and last answer. No second answer is the first one again."""
    first = rules.verdict(asked)
    again = first.where("outcome = 'invalid'").select(*asked.columns).withColumn("answer", F.coalesce("correction", "answer"))
    return first.where("outcome <> 'invalid'").unionByName(rules.verdict(again))


def run(
    documents: DataFrame, answers: DataFrame, store: DataFrame | None, now: str, run_id: str, limit: int = 50, max_age_hours: int = vocab.MAX_AGE_HOURS,
    current: DataFrame | None = None, retries: int = 3, image_fails: Column | None = None,
) -> Run:
    """One bounded run. ``answers`` has (original_url, answer) and may have ``correction``, the second answer, and ``error``: ``outage`` stops asking for this run, any other one fails
    the article. ``store`` has the articles known before, ``current`` their current view (:meth:`sparkwire.store.Store.current`): unfinished ones that are fresh and have retries left are worked on first.
    ``image_fails`` says of which articles the card can't be made."""
    rows = S.entries(documents)
    items = S.articles(rows, now)
    cutoff = F.to_timestamp(F.lit(now)) - F.expr(f"interval {max_age_hours} hours")
    unique = S.across_feeds(items)
    if store is not None:
        unique = unique.join(store.select("url_hash").distinct().withColumn("_known", F.lit(True)), "url_hash", "left")
    else:
        unique = unique.withColumn("_known", F.lit(None).cast("boolean"))
    classes = unique.withColumn("class", schedule.funnel(F.col("published_at"), cutoff, F.col("_known").isNotNull())).drop("_known")
    fresh = classes.where("class = 'fresh'")
    none = {"was": "string", "last_step": "int", "stage_was": "string", "headline": "string", "caption": "string", "category": "string", "revision": "long"}
    fresh = fresh.withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    if current is None:
        resumed = fresh.where(F.lit(False)).withColumn("id", F.lit(None).cast("long"))
    else:
        left = current.where(state.resumable(retries) & schedule.is_fresh(F.col("published_at"), cutoff))
        resumed = left.withColumns({"was": F.col("status"), "stage_was": F.col("error_stage"), "ordinal": F.lit(0), "rank": -F.col("id")}).select("id", *[c for c in fresh.columns if c in left.columns or c in none or c in ("ordinal", "rank")])
    work = schedule.run_list(resumed, fresh, "source_name", "published_at", "ordinal", "rank")
    start = 0 if store is None else (store.agg(F.max("id")).first()[0] or 0)
    work = schedule.numbered(work, [F.col("place")], "_place", first=start + 1)
    work = _with_ids(work, current is not None)
    fresh_rows, old_rows = work.where("is_new"), work.where("not is_new").withColumn("twin_of", F.lit(None).cast("long"))
    if store is not None:
        # only what can be a twin of this run's headlines
        since = F.to_timestamp(F.lit(now)) - F.expr(f"interval {vocab.SAME_STORY_DAYS} days")
        seen = store.where(F.col("discovered_at") >= since).join(fresh_rows.select("title_fingerprint").distinct(), "title_fingerprint", "left_semi")
        seen = seen.select("id", "title_fingerprint", "discovered_at", F.lit(True).alias("_old")).distinct()
        both = fresh_rows.withColumn("_old", F.lit(False)).unionByName(seen, allowMissingColumns=True)
        fresh_rows = dedup.same_story(both).where("not _old").drop("_old")
    else:
        fresh_rows = dedup.same_story(fresh_rows)
    work = fresh_rows.unionByName(old_rows)
    said = answers.withColumns({c: F.lit(None).cast("string") for c in ("error", "correction") if c not in answers.columns}).select(F.col("original_url").alias("_url"), F.col("answer").alias("_answer"), "error", "correction")
    work = work.join(said, F.col("original_url") == F.col("_url"), "left").withColumn("answer", F.coalesce("_answer", F.lit(NO_ANSWER))).drop("_url", "_answer")
    needs = F.col("is_new") | (F.col("was") == "DISCOVERED") | ((F.col("was") == "FAILED") & (F.col("stage_was") == "analyze"))
    work = work.withColumn("needs_answer", F.coalesce(needs, F.lit(False)))
    fates = schedule.run_fates(work, limit, F.col("error") == "outage", F.col("needs_answer"), F.lit(False), F.col("twin_of").isNotNull())
    fates = pinned(fates)
    taken = fates.where(F.col("fate").isin("worked", "returned", "same_story"))
    asks = F.col("needs_answer") & (F.col("fate") == "worked") & F.col("error").isNull()
    asked = with_correction(taken.where(asks))
    silent = taken.where(~asks).withColumns({"outcome": F.lit(None).cast("string"), "rule": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    judged = asked.unionByName(silent)
    fails = F.coalesce(F.lit(False) if image_fails is None else image_fails, F.lit(False))
    has_content = (F.coalesce("headline", F.lit("")) != "") & (F.coalesce("caption", F.lit("")) != "") & (F.coalesce("category", F.lit("")) != "")
    approved = (F.col("outcome") == "approved") | ~F.col("needs_answer")
    status = (
        F.when(F.col("fate") == "same_story", "REJECTED").when(F.col("fate") == "returned", "DISCOVERED")
        .when(F.coalesce(approved, F.lit(False)), F.when(fails | ~has_content, "FAILED").otherwise("READY_FOR_REVIEW")).when(F.col("outcome") == "rejected", "REJECTED").otherwise("FAILED")
    )
    judged = judged.withColumn("status", status).withColumn("error_stage", F.when(F.col("status") == "FAILED", F.when(approved, "image").otherwise("analyze")))
    ready = F.col("status") == "READY_FOR_REVIEW"
    note = F.when(F.col("fate") == "returned", "provider unavailable").when(F.col("status") == "REJECTED", F.when(F.col("twin_of").isNotNull(), F.concat(F.lit("same story as "), F.col("twin_of"))).otherwise(F.col("reason")))
    note = note.when(F.col("error").isNotNull() & F.col("needs_answer"), X.short_error(F.col("error"), vocab.MAX_ERROR_CHARS)).when(F.col("error_stage") == "analyze", F.concat(F.lit("answer failed "), F.col("rule"))).when(F.col("error_stage") == "image", F.when(has_content, "no card").otherwise("approved content is missing"))
    judged = judged.withColumns({
        "image_path": F.when(ready, X.card_file(F.col("url_hash"), F.col("published_at"), F.col("discovered_at"))),
        "card": F.when(ready, fit_headline(F.coalesce("headline", F.lit("")))),
        "path": _path(), "note": note, "revision": F.coalesce(F.col("revision") + 1, F.lit(0).cast("long")),
    }).drop("place", "used", "_place")
    events = events_of(judged, run_id, now)
    per = items.groupBy("feed").agg(F.count("*").alias("items"), F.count_if(schedule.is_fresh(F.col("published_at"), cutoff)).alias("fresh"), F.max("published_at").alias("newest"))
    errors = rows.where("error is not null").select("feed", "error")
    health = documents.select("feed", "ordinal").join(errors, "feed", "left").join(per, "feed", "left").fillna({"items": 0, "fresh": 0})
    return Run(judged, events, classes, health, fates)


def _with_ids(work: DataFrame, has_resumed: bool) -> DataFrame:
    """New rows get the next ids in the order of the list; resumed ones stand before them and keep theirs."""
    if not has_resumed:
        return work.withColumn("id", F.col("_place"))
    n = work.agg(F.count_if(~F.col("is_new")).alias("_resumed"))  # one row
    return work.crossJoin(F.broadcast(n)).withColumn("id", F.when(F.col("is_new"), F.col("_place") - F.col("_resumed")).otherwise(F.col("id"))).drop("_resumed")


def _path() -> Column:
    """The states that an article goes through in the run, from where it was."""
    states = lambda *names: F.array(*map(F.lit, names))
    first = F.when(F.col("is_new"), states("DISCOVERED")).otherwise(F.array().cast("array<string>"))
    made = F.when(F.col("status") == "READY_FOR_REVIEW", states("IMAGE_CREATED", "READY_FOR_REVIEW")).otherwise(states("FAILED"))
    answered = F.concat(first, states("ANALYZING"))
    done = F.when((F.col("error_stage") == "image") | (F.col("status") == "READY_FOR_REVIEW"), F.concat(states("APPROVED"), made)).otherwise(F.array(F.col("status")))
    return (
        F.when(F.col("fate") == "same_story", F.concat(first, states("REJECTED"))).when(F.col("needs_answer"), F.concat(answered, done))
        .when(F.col("was") == "FAILED", F.concat(states("APPROVED"), made)).when(F.col("was") == "IMAGE_CREATED", F.when(F.col("status") == "FAILED", states("FAILED")).otherwise(states("READY_FOR_REVIEW"))).otherwise(made)
    )
