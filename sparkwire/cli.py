"""Command line: ``python -m sparkwire.cli --status`` and so on. Exit codes: 0 well, 1 error, 2 lease held, 3 publishing blocked."""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkwire import settings as conf
from sparkwire.operators import publish, reports, state
from sparkwire.plans import curate
from sparkwire.sources import feeds as S
from sparkwire.store import Lease, LockHeld, Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkwire")
    mode = p.add_mutually_exclusive_group()
    for name in ("dry-run", "doctor", "check-feeds", "status", "publish"):
        mode.add_argument(f"--{name}", action="store_true")
    mode.add_argument("--resolve-unknown", type=int, metavar="ID")
    p.add_argument("--post-id")
    p.add_argument("--not-posted", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--feed", action="append")
    p.add_argument("--ids")
    p.add_argument("--env-file")
    p.add_argument("--documents", help="folder with the feeds' files")
    p.add_argument("--answers", help="JSON lines of original_url and answer")
    p.add_argument("--now", help="the run's time; by default the clock's")
    return p


def ids_of(text: str | None) -> set[int]:
    parts = [p.strip() for p in (text or "").split(",") if p.strip()]
    if not all(p.isdigit() for p in parts):
        raise conf.SettingsError("--ids takes numbers with commas between")
    return set(map(int, parts))


def documents(spark, s, args):
    feeds = S.registry(Path(s.feeds_file).read_text("utf-8"))
    if args.feed:
        feeds = S.selected(feeds, args.feed)
    if not args.documents:
        raise conf.SettingsError("--documents is needed: there is no network transport here")
    return S.from_files(spark, args.documents, S.registry_frame(spark, feeds))


def doctor(s, spark) -> list[tuple[str, str, str]]:
    """Rows (status, what, detail) on the registry, the gates, the store and every rule of the audit, the whole log included."""
    rows = []
    try:
        feeds = S.registry(Path(s.feeds_file).read_text("utf-8"))
        enabled = sum(f.enabled for f in feeds)
        rows.append(("OK" if enabled else "FAIL", "feed registry", f"{enabled} of {len(feeds)} feeds enabled"))
    except (OSError, S.RegistryError) as e:
        rows.append(("FAIL", "feed registry", conf.redact(str(e))))
    closed = publish.closed_gates(s.dry_run, s.publish_enabled, False, s.fb_page_id, s.fb_page_access_token)
    rows.append(("OK" if closed else "WARN", "publishing", "; ".join(closed)))
    store = Store(spark, s.database_path)
    number, manifest = store.manifest()
    rows.append(("OK", "store", f"schema {manifest['schema']}, snapshot {number}, {sum(map(len, manifest['tables'].values()))} folders"))
    current = store.current()
    if current is not None:
        for c in ("category", "catchy_headline", "facebook_caption", "image_path", "facebook_photo_id", "facebook_post_id", "facebook_comment_id"):
            if c not in current.columns:
                current = current.withColumn(c, F.col({"catchy_headline": "headline", "facebook_caption": "caption"}[c]) if c in ("catchy_headline", "facebook_caption") else F.lit(None).cast("string"))
        counts = current.agg(F.count("*").alias("n"), F.count_if(state.unknown_outcome()).alias("unknown"), F.count_if(state.resumable(s.max_retries_per_article)).alias("unfinished")).first()
        rows.append(("WARN" if counts["unknown"] else "OK", "articles", f"{counts['n']} in the store, {counts['unfinished']} unfinished, {counts['unknown']} with an unknown outcome"))
        rows += [("FAIL" if r["violations"] else "OK", r["rule"], str(r["violations"])) for r in state.audit(current, store.read("events")).collect()]
        last = reports.recent_runs(store.runs(), 1).collect() if store.runs() is not None else []
        rows += [("OK" if r["outcome"] == "ok" else "WARN", "last run", f"{r['started_at']} {r['outcome'] or 'running or interrupted'}") for r in last]
    return rows


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.limit is not None and not 1 <= args.limit <= 200:
            raise conf.SettingsError("--limit must be 1 to 200")
        if args.ids and not args.publish:
            raise conf.SettingsError("--ids goes with --publish only")
        ids_of(args.ids)
        s = conf.from_files(args.env_file, os.environ)
        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        now = args.now or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        store = Store(spark, s.database_path)
        if args.doctor:
            rows = doctor(s, spark)
            print("\n".join(f"[{a}] {b}: {c}" for a, b, c in rows))
            return int(any(a == "FAIL" for a, _, _ in rows))
        if args.status:
            current, runs = store.current(), store.runs()
            counts = [] if current is None else reports.status_counts(current).orderBy("place").collect()
            print("\n".join(f"{r['status']:<18} {r['n']}" for r in [*counts, {"status": "total", "n": sum(r["n"] for r in counts)}]))
            for r in [] if current is None else current.where(state.unknown_outcome()).select("id").orderBy("id").collect():
                print(f"unknown outcome: {r['id']}")
            for r in [] if runs is None else reports.recent_runs(runs).collect():
                print(r["started_at"], r["mode"], r["outcome"] or "running or interrupted")
            return 0
        if args.resolve_unknown is not None:
            if (args.post_id is None) == (not args.not_posted):
                raise conf.SettingsError("exactly one of --post-id and --not-posted is needed")
            store.resolve(args.resolve_unknown, args.post_id, uuid.uuid4().hex, now)
            return 0
        if args.publish:
            if closed := publish.closed_gates(s.dry_run, s.publish_enabled, True, s.fb_page_id, s.fb_page_access_token):
                raise publish.Blocked("; ".join(closed))
            raise publish.Blocked("there is no live client here")
        docs = documents(spark, s, args)
        hours = int(s.max_article_age_hours)
        if args.check_feeds:
            items = S.articles(S.entries(docs), now).select("feed", "published_at")
            errors = S.entries(docs).where("error is not null").select("feed", "error")
            cutoff = F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours")
            health = reports.feed_health(docs.select("feed", "ordinal").join(errors, "feed", "left"), items, cutoff).orderBy("ordinal").collect()
            for r in health:
                print(f"[{'FAIL' if r['error'] else 'OK'}] {r['feed']}: " + (r["error"] or f"{r['fresh']} fresh of {r['items']}"))
            return int(bool(health) and all(r["error"] for r in health))
        lease, run_id = Lease(s.database_path), uuid.uuid4().hex
        lease.acquire(run_id, datetime.fromisoformat(now))
        try:
            store.start(run_id, "dry-run", now)
            recovered = store.recover(run_id, now)
            answers = spark.read.schema("original_url string, answer string, correction string, error string").json(args.answers) if args.answers else spark.createDataFrame([], "original_url string, answer string")
            run = curate.run(docs, answers, store.read("articles"), now, run_id, args.limit or s.max_articles_per_run, hours, current=store.current(), retries=s.max_retries_per_article)
            counters, by = reports.Counters(), F.lit(run_id)
            # articles, their events and what the run saw become visible together
            store.commit(
                articles=counters.articles(run.articles.drop("card")), events=lambda done: curate.events_of(done["articles"], run_id, now),
                sightings=counters.funnel(run.classes.select("url_hash", "source_name", "published_at", "class", by.alias("run_id"))), feed_health=counters.feeds(run.health.withColumn("run_id", by)),
            )
            summary = counters.values(recovered=recovered)
            store.finish(run_id, "dry-run", now, now, "ok", summary)
            print(reports.format_summary(summary))
        finally:
            lease.release(run_id)
        return 0
    except LockHeld as e:
        print(f"not started: {e}", file=sys.stderr)
        return 2
    except publish.Blocked as e:
        print(f"publishing is blocked: {e}", file=sys.stderr)
        return 3
    except (conf.SettingsError, S.RegistryError, ValueError, OSError) as e:
        print(f"error: {conf.redact(str(e))}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
