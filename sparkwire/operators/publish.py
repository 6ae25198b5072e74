"""The gated outside sink: gates, response classes, outcome rules, reconciliation, previews. There is a mock client and no
real one: nothing here writes to a network."""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.functions import text as X


def closed_gates(dry_run: bool, enabled: bool, flag: bool, page_id: str, token: str) -> list[str]:
    """Why nothing may be published; empty if all gates are open."""
    checks = (
        (dry_run, "DRY_RUN is true"), (not enabled, "PUBLISH_ENABLED is false"), (not flag, "the --publish flag was not given"),
        (not page_id, "FB_PAGE_ID is missing"), (not token, "FB_PAGE_ACCESS_TOKEN is missing"),
    )
    return [reason for closed, reason in checks if closed]


class Blocked(RuntimeError):
    pass


@dataclass
class MockClient:
    """Answers from a script, and keeps what it was sent."""

    answers: list[tuple[str, str | None]] = field(default_factory=list)
    sent: list[tuple[str, str]] = field(default_factory=list)

    def __call__(self, kind: str, message: str) -> tuple[str, str | None]:
        self.sent.append((kind, message))
        return self.answers.pop(0) if self.answers else ("ok", f"{kind}-{len(self.sent)}")


def publish(rows: list[dict], client: Callable, gates: Callable[[], list[str]], record: Callable[[dict], None]) -> int:
    """Photo, then comment, of each row in order, gates asked before every request and each step recorded before
    the next. An outcome that makes more requests pointless or risky stops the run. Returns the writes made."""
    writes = 0
    for r in rows:
        for kind, message in (("photo", r["facebook_caption"]), ("comment", vocab.COMMENT_PREFIX + r["original_url"])):
            if reasons := gates():
                raise Blocked("; ".join(reasons))
            record({"id": r["id"], "step": kind, "outcome": "intended", "external_id": None})
            outcome, external = client(kind, message)
            record({"id": r["id"], "step": kind, "outcome": outcome, "external_id": external})
            writes += outcome == "ok"
            if outcome in ("unknown", "not_sent", "auth", "rate_limit"):
                return writes
            if outcome != "ok":
                break
    return writes


def classify_response(status: Column, is_object: Column, has_error: Column, code: Column, flagged_transient: Column, ambiguous: Column) -> Column:
    """ok, unknown, refused, auth, rate_limit or transient, from what came back.

    ``ambiguous``: a repeat could act twice, so what may have happened counts as unknown.
    """
    success = (status >= 200) & (status < 300)
    limited = (status == 429) | F.coalesce(code.isin(*vocab.RATE_LIMIT_CODES), F.lit(False))
    auth = F.coalesce(code.isin(*vocab.AUTH_CODES, *vocab.PERMISSION_CODES), F.lit(False))
    transient = F.coalesce(flagged_transient, F.lit(False)) | F.coalesce(code.isin(*vocab.TRANSIENT_CODES), F.lit(False))
    return (
        F.when(success & is_object & ~has_error, "ok")
        .when(success | (status >= 500), "unknown")
        .when(~has_error & ambiguous & (status != 429), "unknown")
        .when(~has_error, F.when(status == 429, "rate_limit").otherwise("refused"))
        .when(ambiguous & transient & ~limited, "unknown")
        .when(auth, "auth")
        .when(limited, "rate_limit")
        .when(transient, "transient")
        .otherwise("refused")
    )


def stops_publishing(outcome: Column) -> Column:
    return outcome.isin("unknown", "not_sent", "auth", "rate_limit")


def map_provider_error(kind: Column, status: Column) -> Column:
    """Whether an answer provider's error is transient: timeouts and networks, 429 and 5xx."""
    return F.coalesce(kind.isin("timeout", "network") | (status == 429) | (status >= 500), F.lit(False))


def is_outage(transient: Column, status: Column) -> Column:
    return transient | F.coalesce(status.isin(401, 403, 404), F.lit(False))


def backoff(attempt: Column, retry_after: Column) -> Column:
    return F.least(F.lit(120.0), F.greatest(2.0 * F.pow(F.lit(2.0), attempt - 1), F.coalesce(retry_after, F.lit(0.0))))


def reconciled(pending: DataFrame, comments: DataFrame, page_id: str, most: int = 500) -> DataFrame:
    """pending with ``comment_id``: the page's own comment with exactly the intended text among the newest ``most``."""
    mine = comments.where((F.col("author_id") == page_id) & (F.col("position") < most))
    mine = mine.groupBy("object_id", "message").agg(F.min_by("comment_id", "position").alias("comment_id"))
    want = pending.withColumn("message", X.comment_text(F.col("original_url")))
    return want.join(mine, (F.col("target") == F.col("object_id")) & (want["message"] == mine["message"]), "left").drop("object_id", "message")


def payload(version: str) -> Column:
    """What a live run would send for an article, without secrets."""
    return F.struct(
        F.struct(
            F.lit(f"/{version}/{{page-id}}/photos").alias("request"),
            F.struct(F.element_at(F.split("image_path", "/"), -1).alias("source"), F.col("facebook_caption").alias("caption"), F.lit("true").alias("published")).alias("fields"),
        ).alias("photo"),
        F.struct(F.lit(f"/{version}/{{post-id}}/comments").alias("request"), X.comment_text(F.col("original_url")).alias("message")).alias("comment"),
    )


def previews(articles: DataFrame, version: str, now: str) -> DataFrame:
    """(id, document) with the JSON preview of each article that has a category and an image; write with ``df.write.text``."""
    ready = articles.where("category is not null and image_path is not null")
    doc = F.struct(
        F.col("id").alias("article_id"), F.lit("READY_FOR_REVIEW").alias("state"), F.col("source_name").alias("source"), F.col("title").alias("original_title"),
        "published_at", "category", F.col("catchy_headline").alias("headline"), F.col("facebook_caption").alias("caption"), "original_url", "image_path",
        payload(version).alias("future_payload"), F.lit(False).alias("write_performed"), F.lit(now).alias("generated_at"),
    )
    return ready.select("id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def review_page(ready: DataFrame, rejected: DataFrame, failed: DataFrame, posted: int) -> str:
    """The escaped review page, from bounded lists: 100 ready, 30 refused and 30 failed at most."""
    parts = [f"<p>{posted} posted</p>"]
    for name, df, most, cols in (
        ("Ready", ready, 100, ("catchy_headline", "facebook_caption", "original_url")),
        ("Rejected", rejected, 30, ("title", "rejection_reason")),
        ("Failed", failed, 30, ("title", "last_error")),
    ):
        parts.append(f"<h2>{name}</h2>")
        for r in df.select(*cols).limit(most).collect():
            parts.append("<article>" + "".join(f"<p>{html.escape(str(r[c] or ''), quote=True)}</p>" for c in cols) + "</article>")
    return "<!DOCTYPE html><html><body>" + "\n".join(parts) + "</body></html>"
