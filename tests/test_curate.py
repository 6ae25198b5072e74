"""Runs that go on where the last one ended: outages, corrections, retries, recovery, limits, and the counters of each."""

import pytest
from pyspark.sql import functions as F

from sparkwire.operators import fold, reports, rules
from sparkwire.plans import curate
from sparkwire.store import Store
from sparkwire.streaming.dedup import watched_late
from tests.test_engine import NOW, answer, documents, item, rss

URL = "https://x.example/{}".format
KIND = "original_url string, answer string, correction string, error string"


@pytest.fixture()
def line(spark, tmp_path):
    """(run, store): a run over feeds of items and scripted answers; gives its counters."""
    store, n = Store(spark, str(tmp_path / "store")), [0]

    def run(items, said=(), limit=50, now=NOW, image_fails=None, retries=3):
        n[0] += 1
        name = f"r{n[0]}"
        recovered = store.recover(name, now)
        docs = documents(spark, *items.items()) if isinstance(items, dict) else documents(spark, ("a", rss(*items)))
        answers = spark.createDataFrame([(u, *(x if isinstance(x, tuple) else (x, None, None))) for u, x in dict(said).items()], KIND)
        done = curate.run(docs, answers, store.read("articles"), now, name, limit, current=store.current(), retries=retries, image_fails=image_fails)
        c = reports.Counters()
        store.commit(
            articles=c.articles(done.articles.drop("card")), events=lambda made: curate.events_of(made["articles"], name, now), sightings=c.funnel(done.classes.select("url_hash", "class")), feed_health=c.feeds(done.health)
        )
        counted = c.values(recovered=recovered)
        # what the passes counted is what a second look finds
        got = store.read("sightings").count() if n[0] == 1 else None
        assert got in (None, counted["fetched"])
        return counted

    return run, store


def states(store):
    return {r["original_url"][-1]: (r["status"], r["error_stage"], r["retry_count"]) for r in store.current().collect()}


def log_is_sound(store):
    events = store.read("events").withColumn("order", F.struct("created_at", "step"))
    return fold.replay(events, order=("order",)).where("not accepted").isEmpty()


def good(i):
    return answer(original_url=URL(i))


HEADS = ["Robot maker opens plant near the harbour", "Bank lends more to small shops this year", "Chip prices fall for a third month running", "Court lets two airlines merge after all", "New battery lasts a week in field trials"]


def items(*ids, hours=range(1, 10)):
    return [item(HEADS[i], URL(i), f"Mon, 28 Sep 2026 {12 - h:02d}:00:00 GMT") for i, h in zip(ids, hours, strict=False)]


def test_an_outage_stops_asking_and_leaves_work_for_the_next_run(line):
    run, store = line
    c = run(items(0, 1), {URL(0): (None, None, "outage"), URL(1): good(1)})
    assert (c["analyzed"], c["failed"], c["fetched"]) == (0, 0, 2)
    assert states(store) == {"0": ("DISCOVERED", None, 0)}  # the second one was not even registered
    c = run(items(0, 1), {URL(0): good(0), URL(1): good(1)})
    assert (c["ready_for_review"], c["resumed"], c["analyzed"], c["duplicates"]) == (2, 1, 2, 1)
    assert {s for s, _, _ in states(store).values()} == {"READY_FOR_REVIEW"} and log_is_sound(store)
    assert sorted(r["id"] for r in store.current().collect()) == [1, 2]


def test_invalid_answers_use_up_the_retries(line):
    run, store = line
    bad = answer(original_url=URL(0), category="NOT A CATEGORY")
    for tries in (1, 2, 3):
        c = run(items(0), {URL(0): (bad, bad, None)})
        assert states(store) == {"0": ("FAILED", "analyze", tries)} and c["failed"] == 1 and c["resumed"] == int(tries > 1)
    c = run(items(0), {URL(0): good(0)})
    assert (c["resumed"], c["analyzed"]) == (0, 0) and states(store)["0"][0] == "FAILED" and log_is_sound(store)


def test_one_correction_counts(line):
    run, store = line
    bad = answer(original_url=URL(0), catchy_headline="Too short")
    c = run(items(0, 1, 2), {URL(0): (bad, good(0), None), URL(1): (bad, bad, None), URL(2): (bad, None, None)})
    assert (c["approved"], c["failed"], c["analyzed"]) == (1, 2, 1)
    assert {k: v[0] for k, v in states(store).items()} == {"0": "READY_FOR_REVIEW", "1": "FAILED", "2": "FAILED"}


def test_a_failed_card_resumes_without_an_answer_until_the_retries_are_used_up(line):
    run, store = line
    c = run(items(0), {URL(0): good(0)}, image_fails=F.lit(True))
    assert (c["approved"], c["failed"], c["analyzed"]) == (1, 1, 1) and states(store) == {"0": ("FAILED", "image", 1)}
    for tries in (2, 3):
        c = run(items(0), {URL(0): (None, None, "outage")}, image_fails=F.lit(True))
        assert (c["resumed"], c["analyzed"]) == (1, 0) and states(store) == {"0": ("FAILED", "image", tries)}
    assert run(items(0), image_fails=F.lit(True))["resumed"] == 0
    c = run(items(0), retries=4)
    assert c["ready_for_review"] == 1 and states(store)["0"][0] == "READY_FOR_REVIEW" and log_is_sound(store)
    assert store.current().first()["headline"] and store.read("articles").count() == 4


def test_other_errors_are_charged_to_the_article(line):
    run, store = line
    c = run(items(0, 1), {URL(0): (None, None, "KeyError: bug in provider"), URL(1): good(1)}, image_fails=F.col("original_url") == URL(1))
    assert states(store) == {"0": ("FAILED", "analyze", 1), "1": ("FAILED", "image", 1)} and c["failed"] == 2
    notes = {r["note"] for r in store.read("events").where("to_status = 'FAILED'").collect()}
    assert notes == {"KeyError: bug in provider", "no card"}


def test_recovered_and_resumed_are_counted_apart(line, spark):
    run, store = line
    run(items(0), {URL(0): (None, None, "outage")})
    schema = store.read("events").schema
    at = store.current().first()
    crash = {"article_id": at["id"], "run_id": "crash", "from_status": "DISCOVERED", "to_status": "ANALYZING", "step": at["last_step"] + 1}
    rows = spark.createDataFrame([tuple(crash.get(f.name) for f in schema)], schema).withColumn("created_at", F.to_timestamp(F.lit(NOW)))
    store.append("events", rows)
    c = run(items(0), {URL(0): good(0)})
    assert (c["recovered"], c["resumed"], c["ready_for_review"]) == (1, 1, 1) and log_is_sound(store)


def test_limit_counts_resumed_work_first(line):
    run, store = line
    assert run(items(0, 1, 2, 3), {URL(i): good(i) for i in range(4)}, limit=2)["analyzed"] == 2
    assert set(states(store)) == {"0", "1"}  # the newest
    run(items(4), {URL(4): (None, None, "outage")})
    c = run(items(0, 1, 2, 3), {URL(i): good(i) for i in range(5)}, limit=2)
    assert c["resumed"] == 1 and c["analyzed"] == 2 and set(states(store)) == {"0", "1", "2", "4"}


def test_stale_work_is_not_resumed(line):
    run, store = line
    run(items(0), {URL(0): (None, None, "outage")})
    c = run(items(1), {URL(0): good(0)}, now="2026-10-01 12:00:00")
    assert (c["resumed"], c["too_old"]) == (0, 1) and states(store) == {"0": ("DISCOVERED", None, 0)}


def test_all_counters(line):
    run, store = line
    said = {URL(0): good(0), URL(1): answer(is_relevant=False, rejection_reason="Not our field.", original_url=URL(1)), URL(2): answer(original_url=URL(2), category="Gossip")}
    feeds = {
        "a": rss(*items(0, 1, 2), item("Old news", URL(7), "Mon, 21 Sep 2026 07:15:00 GMT"), item("No date", URL(8), None)),
        "b": rss(item("Other title", URL(0), "Mon, 28 Sep 2026 05:00:00 GMT"), item(HEADS[0], "https://y.example/9", "Mon, 28 Sep 2026 04:00:00 GMT")), "c": None,
    }
    c = run(feeds, said)
    assert tuple(c) == reports.COUNTERS and len(c) == 15
    assert c == dict(zip(reports.COUNTERS, (2, 1, 6, 1, 1, 0, 1, 2, 1, 1, 1, 1, 0, 0, 0), strict=True))
    assert run(feeds, said)["duplicates"] == 3 + 1 and log_is_sound(store)


def test_an_empty_run_counts_nothing(line):
    run, store = line
    assert set(run({"a": rss()}, {}).values()) == {0, 1}
    assert store.current().count() == 0


def test_late_rows_are_counted_as_they_are_dropped(spark, tmp_path):
    rows = [(i, f"2026-09-{d:02d} 12:00:00") for i, d in enumerate((28, 27, 26, 25, 20))] + [(9, None)]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.to_timestamp("t").alias("published_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = watched_late(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), NOW, 48)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
    seen = [p["observedMetrics"]["freshness"] for p in q.recentProgress if p["numInputRows"]]
    assert sum(x["too_old"] for x in seen) == 2 and sum(x["undated"] for x in seen) == 1


def test_chosen_and_correction_agree_with_the_rules(spark):
    """The correction round of a run is the one of the rules."""
    rows = [("u1", answer(original_url="u1"), None), ("u2", "", answer(original_url="u2")), ("u3", "", "{}")]
    asked = spark.createDataFrame([(*r, "Robot maker opens plant", "New.", "Wire") for r in rows], "original_url string, answer string, correction string, title string, summary string, source_name string")
    got = {r["original_url"]: (r["outcome"], r["rule"]) for r in curate.with_correction(asked).collect()}
    second = rules.verdict(asked.withColumn("answer", F.coalesce("correction", "answer")))
    want = {r["original_url"]: (r["outcome"], r["rule"]) for r in rules.corrected(rules.verdict(asked), second).collect()}
    assert got == want == {"u1": ("approved", None), "u2": ("approved", None), "u3": ("invalid", "V03")}
