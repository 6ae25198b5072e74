import json

import pytest
from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.operators import dedup, publish, reports, rules, schedule, state
from sparkwire.plans import curate
from sparkwire.sources import feeds as S
from sparkwire.streaming import dedup as stream

NOW = "2026-09-28 12:00:00"


def test_registry():
    got = S.registry("feeds:\n - {name: A, url: 'https://a.example/f.xml'}\n - {name: b, url: 'http://b.example/', enabled: false}\n")
    assert [f.enabled for f in got] == [True, False]
    assert S.selected(got, ["B"]) == [S.Feed("b", "http://b.example/", True)]
    with pytest.raises(S.RegistryError):
        S.selected(got, ["zzz"])
    for bad in ("", "feeds: []", "feeds: [1]", "feeds: [{name: a}]", "feeds: [{name: a, url: 'ftp://x'}]", "feeds: [{name: a, url: 'http://x', enabled: 'yes'}]", "feeds: [{name: a, url: 'http://x'}, {name: A, url: 'http://y'}]"):
        with pytest.raises(S.RegistryError):
            S.registry(bad)


def test_targets():
    public = lambda h: ["93.184.216.34"]
    assert S.is_public_target("https://example.com/x", public)
    assert not S.is_public_target("https://example.com/x", lambda h: ["93.184.216.34", "10.0.0.1"])
    for bad in ("http://localhost/", "http://127.0.0.1/", "http://0x7f.1/", "http://2130706433/", "ftp://example.com/", "http://[::1]/"):
        assert not S.is_public_target(bad, public)
    assert not S.may_redirect("https://a", "http://a", 1) and not S.may_redirect("http://a", "http://b", 6)


def rss(*items, language="en"):
    body = "".join(f"<item>{i}</item>" for i in items)
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><language>{language}</language>{body}</channel></rss>'.encode()


def item(title, link, date="Mon, 28 Sep 2026 07:15:00 GMT", text="Body."):
    d = f"<pubDate>{date}</pubDate>" if date else ""
    return f"<title>{title}</title><link>{link}</link>{d}<description>{text}</description>"


def documents(spark, *feeds):
    return spark.createDataFrame([(n, i, f"https://{n}.example/f.xml", bytearray(c) if c is not None else None, None if c is not None else "timed out") for i, (n, c) in enumerate(feeds)], S.DOCUMENTS)


def test_parse():
    got, error = S.parsed(rss(item("A", "https://x.example/a")))
    assert error is None and got[0]["title"] == "A" and got[0]["published"] == "2026-09-28 07:15:00" and got[0]["language"] == "en"
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://x.example/t"/><updated>2026-09-28T09:00:00+02:00</updated><id>i</id></entry></feed>'
    got, _ = S.parsed(atom)
    assert got[0]["link"] == "https://x.example/t" and got[0]["published"] == "2026-09-28 07:00:00" and got[0]["guid"] == "i"
    assert S.parsed(b"<!DOCTYPE x [<!ENTITY a 'b'>]><rss/>")[1].startswith("feed declares")
    assert S.parsed(b"<<this is not")[1].startswith("malformed")
    assert len(S.parsed(rss(item("A", "https://x.example/a"))[:-10])[0]) == 1


def test_articles(spark):
    docs = documents(
        spark,
        ("a", rss(item("Old", "https://x.example/1", "Thu, 01 Jan 1960 00:00:00 GMT"), item("Future", "https://x.example/2", "Thu, 01 Jan 2099 00:00:00 GMT"), item("Again", "https://x.example/2?utm_source=q"), item("", "https://x.example/3"), item("Bad", "javascript:x"), item("Long", "https://x.example/" + "a" * 3000), item("Undated", "https://x.example/4", None))),
        ("b", rss(item("Other", "https://x.example/2#f"))),
        ("c", None),
    )
    rows = S.entries(docs).cache()
    assert [r["error"] for r in rows.where("error is not null").collect()] == ["timed out"]
    a = S.articles(rows, NOW).orderBy("ordinal", "rank").collect()
    assert [r["title"] for r in a] == ["Future", "Old", "Undated", "Other"]
    assert str(a[0]["published_at"]) == NOW
    assert {r["title"] for r in S.across_feeds(S.articles(rows, NOW)).collect()} == {"Future", "Old", "Undated"}


def test_fair_order_and_limits(spark):
    rows = [(i, "busy", 100 - i) for i in range(6)] + [(9, "quiet", 1)]
    df = spark.createDataFrame(rows, "id int, source string, t int")
    assert [r["id"] for r in schedule.work_list(df, "source", F.col("t"), "id", limit=3).orderBy("position").collect()] == [0, 9, 1]
    work = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "p int, consumes boolean")
    assert [r["p"] for r in schedule.within_limit(work, "p", F.col("consumes"), 2).orderBy("p").collect()] == [1, 2, 3]


def test_same_story_window(spark):
    rows = [(1, "f", "2026-09-01 00:00:00"), (2, "f", "2026-09-08 00:00:00"), (3, "f", "2026-09-16 00:00:01"), (4, None, "2026-09-16 00:00:00")]
    df = spark.createDataFrame(rows, "id long, title_fingerprint string, discovered_at string")
    assert [r["twin_of"] for r in dedup.same_story(df).orderBy("id").collect()] == [None, 1, None, None]


def test_register_and_conflicts(spark):
    store = spark.createDataFrame([("h1", "u1", 1, "DISCOVERED")], "url_hash string, canonical_url string, id int, status string")
    df = spark.createDataFrame([("h1", "u1", 0), ("h2", "u1", 1), ("h3", "u3", 2), ("h3", "u3", 3)], "url_hash string, canonical_url string, n int")
    assert {(r["url_hash"], r["is_new"]) for r in dedup.conflicts(df, store).collect()} == {("h1", False), ("h2", False), ("h3", True)}
    assert [(r["url_hash"], r["n"], r["id"]) for r in dedup.registered(df, store, 2, "n").collect()] == [("h3", 2, 2)]


def log(spark, *statuses):
    rows = [(i, 1, "r", a, b, s, None, None) for i, (a, b, s) in enumerate(statuses)]
    return spark.createDataFrame(rows, state.EVENT)


def test_transitions(spark):
    pairs = {(a, b): s for a, b, s in vocab.TRANSITIONS}
    assert len(pairs) == 20
    rows = [(a, b, s) for a in vocab.STATUSES for b in vocab.STATUSES for s in (None, *vocab.STAGES)]
    df = spark.createDataFrame(rows, "a string, b string, s string").withColumn("ok", state.is_allowed(F.col("a"), F.col("b"), F.col("s")))
    for r in df.collect():
        assert r["ok"] == ((r["a"], r["b"]) in pairs and pairs[(r["a"], r["b"])] in (None, r["s"])), r


def test_retry_budget(spark):
    """Image failures resume by way of APPROVED and use the budget up; completing a stage resets it."""
    events = [(None, "DISCOVERED", None), ("DISCOVERED", "ANALYZING", None), ("ANALYZING", "APPROVED", None)]
    events += [("APPROVED", "FAILED", "image"), ("FAILED", "APPROVED", None)] * 2
    assert state.retry_counts(log(spark, *events)).first()["retry_count"] == 2
    events += [("APPROVED", "IMAGE_CREATED", None), ("IMAGE_CREATED", "READY_FOR_REVIEW", None)]
    assert state.retry_counts(log(spark, *events)).first()["retry_count"] == 0
    assert state.invalid(log(spark, *events)).count() == 0
    assert state.lost_updates(log(spark, (None, "DISCOVERED", None), ("DISCOVERED", "ANALYZING", None), ("DISCOVERED", "REJECTED", None))).count() == 1


def test_recovery_and_resolution(spark):
    df = spark.createDataFrame([(1, "ANALYZING", None, None), (2, "PUBLISHING", None, None), (3, "APPROVED", None, None)], "id int, status string, error_stage string, facebook_post_id string")
    r = state.recovered(df)
    assert [tuple(x)[1:3] for x in r.select("id", "status", "error_stage").orderBy("id").collect()] == [("DISCOVERED", None), ("FAILED", "publish_unknown"), ("APPROVED", None)]
    assert state.resolved(r, 2, "p9").where("id = 2").first()["status"] == "POST_CREATED"
    assert state.resolved(r, 2, None).where("id = 2").first()["error_stage"] == "publish_photo"


def answer(**k):
    return json.dumps({"is_relevant": True, "category": "AI", "catchy_headline": "Robot Maker Opens New Plant Near The Harbour", "facebook_caption": "A maker of small robots has opened a new plant near the old harbour. #Tech #AI", "original_url": "https://x.example/a", "rejection_reason": None} | k)


@pytest.mark.parametrize(
    "raw, rule",
    [
        (answer(), None),
        (answer(category="Gossip"), "V06"),
        (answer(original_url="https://x.example/b"), "V07"),
        (answer(catchy_headline="As an AI model I cannot say more"), "V08"),
        (answer(catchy_headline="Short one"), "V10"),
        (answer(catchy_headline="Robot Maker Opens Новый Plant Near The Harbour"), "V16"),
        (answer(facebook_caption="A maker of small robots has opened 5 new plants near the old harbour. #Tech #AI"), "V25"),
        (answer(facebook_caption="Buy now: a maker of small robots has opened a plant near the harbour. #Tech #AI"), "V26"),
        (answer(facebook_caption="A maker of small robots at evil.example has opened a plant by the harbour. #Tech #AI"), "V27"),
        (answer(is_relevant="true"), "V03"),
        (answer(extra=1), "V03"),
        ("", "V01"),
    ],
)
def test_verdicts(spark, raw, rule):
    df = spark.createDataFrame([(raw, "Robot maker opens plant", "It is new.", "Wire", "https://x.example/a")], "answer string, title string, summary string, source_name string, original_url string")
    r = rules.verdict(df).first()
    assert r["rule"] == rule and r["outcome"] == ("invalid" if rule else "approved")


def test_gates_and_sink():
    assert publish.closed_gates(False, True, True, "p", "t") == [] and len(publish.closed_gates(True, False, False, "", "")) == 5
    seen, client = [], publish.MockClient([("ok", "1"), ("ok", "2"), ("unknown", None)])
    rows = [{"id": i, "facebook_caption": "c", "original_url": "u"} for i in range(3)]
    assert publish.publish(rows, client, lambda: [], seen.append) == 2
    assert [s["outcome"] for s in seen] == ["intended", "ok", "intended", "ok", "intended", "unknown"]
    with pytest.raises(publish.Blocked):
        publish.publish(rows, client, lambda: ["closed"], seen.append)


def test_reconcile(spark):
    pending = spark.createDataFrame([(1, "o", "https://x.example/a")], "id int, target string, original_url string")
    comments = spark.createDataFrame([("o", "me", "Read full story: https://x.example/a", "c1", 3), ("o", "them", "Read full story: https://x.example/a", "c0", 1)], "object_id string, author_id string, message string, comment_id string, position int")
    assert publish.reconciled(pending, comments, "me").first()["comment_id"] == "c1"
    assert publish.reconciled(pending, comments, "you").first()["comment_id"] is None


def test_whole_run(spark):
    ok = {f"https://x.example/{i}": answer(original_url=f"https://x.example/{i}") for i in range(3)}
    bad = {"https://x.example/3": answer(original_url="https://x.example/3", facebook_caption="A maker of small robots has opened 5 new plants near the old harbour. #Tech #AI")}
    docs = documents(
        spark,
        ("a", rss(*[item(f"Robot maker opens plant number {'abcd'[i]} today", f"https://x.example/{i}") for i in range(4)], item("Old news of the day before", "https://x.example/8", "Mon, 21 Sep 2026 07:15:00 GMT"), item("No date on this one", "https://x.example/9", None))),
        ("b", rss(item("Robot maker opens plant number a today", "https://y.example/1", "Mon, 28 Sep 2026 06:00:00 GMT"), item("Match report of the last game", "https://y.example/2", "Mon, 28 Sep 2026 05:00:00 GMT"))),
        ("c", None),
    )
    answers = spark.createDataFrame(list((ok | bad).items()), "original_url string, answer string")
    run = curate.run(docs, answers, None, NOW, "r1")
    got = {r["status"]: r["n"] for r in reports.status_counts(run.articles).collect()}
    assert got == {"READY_FOR_REVIEW": 3, "REJECTED": 2, "FAILED": 1}
    assert {r["class"]: r["count"] for r in run.classes.groupBy("class").count().collect()} == {"fresh": 6, "too_old": 1, "undated": 1}
    assert run.articles.where("twin_of is not null").count() == 1
    assert {r["feed"]: (r["items"], r["error"]) for r in run.health.collect()} == {"a": (6, None), "b": (2, None), "c": (0, "timed out")}
    events = run.events.withColumn("event_id", F.monotonically_increasing_id())
    assert state.invalid(events.drop("event_id").withColumnRenamed("step", "event_id")).count() == 0
    assert run.articles.where("status = 'READY_FOR_REVIEW'").first()["image_path"].startswith("2026-09-28_")


def test_stream_appends_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "k string, n int").write.parquet(src)
    for _ in range(2):
        s = spark.readStream.schema("k string, n int").parquet(src)
        stream.append_new(s, store, str(tmp_path / "cp"), "k", "n").start().awaitTermination()
        spark.createDataFrame([("k2", 9), ("k3", 4)], "k string, n int").write.mode("append").parquet(src)
    assert sorted((r["k"], r["n"]) for r in spark.read.parquet(store).collect()) == [("k1", 1), ("k2", 3), ("k3", 4)]
