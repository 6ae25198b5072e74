import json
import logging
from datetime import datetime

import pytest

from sparkwire import cli, settings
from sparkwire.store import Lease, LockHeld, Store
from tests.test_engine import NOW, answer, item, rss


def test_settings():
    s = settings.load({"DRY_RUN": "off", "MAX_ARTICLES_PER_RUN": " 7 ", "CARD_TAGLINE": "x" * 40, "AI_TEMPERATURE": ""})
    assert s.dry_run is False and s.max_articles_per_run == 7 and len(s.card_tagline) == 28 and s.ai_temperature is None and s.publish_enabled is False
    for bad in ({"DRY_RUN": "maybe"}, {"MAX_ARTICLES_PER_RUN": "0"}, {"MAX_ARTICLES_PER_RUN": "x"}, {"FB_PAGE_ID": "abc"}, {"FB_GRAPH_API_VERSION": "26"}, {"AI_PROVIDER": "z"}, {"LOG_LEVEL": "loud"}):
        with pytest.raises(settings.SettingsError):
            settings.load(bad)
    assert settings.parse_env("A=1\n# B=2\nexport C='x y' # c\n") == {"A": "1", "C": "x y"}


def test_log_is_redacted():
    record = logging.LogRecord("n", 20, "f", 1, "token=abcdef and hunter22", None, None)
    assert "abcdef" not in settings.RedactingFormatter(["hunter22"]).format(record) and "hunter22" not in settings.RedactingFormatter(["hunter22"]).format(record)


def test_lease(tmp_path):
    a, b = Lease(str(tmp_path)), Lease(str(tmp_path))
    a.acquire("r1", datetime(2026, 1, 1, 12, 0))
    with pytest.raises(LockHeld):
        b.acquire("r2", datetime(2026, 1, 1, 12, 29))
    b.acquire("r2", datetime(2026, 1, 1, 12, 31))
    with pytest.raises(LockHeld):
        a.refresh("r1", datetime(2026, 1, 1, 12, 32))
    a.release("r1")
    b.refresh("r2", datetime(2026, 1, 1, 12, 33))
    b.release("r2")
    a.acquire("r3", datetime(2026, 1, 1, 12, 34))


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    feeds = tmp_path / "feeds.yaml"
    feeds.write_text("feeds:\n - {name: A, url: 'https://a.example/a.xml'}\n - {name: B, url: 'https://a.example/b.xml'}\n")
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.xml").write_bytes(rss(item("Robot maker opens plant number a today", "https://x.example/1"), item("Match report of the last game", "https://x.example/2")))
    (tmp_path / "answers.json").write_text(json.dumps({"original_url": "https://x.example/1", "answer": answer(original_url="https://x.example/1")}))
    monkeypatch.setenv("FEEDS_FILE", str(feeds))
    monkeypatch.setenv("DATABASE_PATH", str(tmp_path / "db"))
    run = lambda *a: cli.main([*a, "--now", NOW], spark)
    assert run("--check-feeds", "--documents", str(docs)) == 0
    assert "[OK] A: 2 fresh of 2" in (out := capsys.readouterr().out) and "[FAIL] B: HTTP 404" in out
    for _ in range(2):
        assert run("--documents", str(docs), "--answers", str(tmp_path / "answers.json")) == 0
    assert "duplicates: 2" in capsys.readouterr().out
    assert run("--status") == 0
    out = capsys.readouterr().out
    assert out.splitlines()[:3] == ["REJECTED           1", "READY_FOR_REVIEW   1", "total              2"] and out.count("dry-run ok") == 2
    assert run("--doctor") == 0
    assert run("--publish") == 3 and run("--publish", "--ids", "x") == 1 and run("--ids", "1") == 1 and run("--limit", "0") == 1
    assert run("--resolve-unknown", "1") == 1 and run("--resolve-unknown", "1", "--not-posted") == 1
    assert Store(spark, str(tmp_path / "db")).current().count() == 2


def test_one_run_gets_the_lease(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def ask(i):
        try:
            Lease(str(tmp_path)).acquire(f"r{i}", datetime(2026, 1, 1))
            return True
        except LockHeld:
            return False

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(ask, range(40))) == 1


def test_a_commit_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = spark.range(3)

    def fails(done):
        assert done["a"].count() == 3
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.commit(a=one, b=fails)
    assert store.read("a") is None and store.read("b") is None
    made = store.commit(a=one, b=lambda done: done["a"].where("id > 0"))
    assert store.read("a").count() == 3 and store.read("b").count() == 2 == made["b"].count()


def test_feed_files_are_told_apart(spark, tmp_path, monkeypatch):
    from sparkwire.sources import feeds as S

    monkeypatch.setattr(S, "MAX_FEED_BYTES", 50)
    for name, n in (("alpha-news.xml", 10), ("rss", 20), ("only.xml", 30), ("big.xml", 60)):
        (tmp_path / name).write_bytes(b"x" * n)
    rows = [("Alpha News", "https://a.example/rss", True, 0), ("Beta", "https://b.example/rss", True, 1), ("Gamma", "https://c.example/only.xml", True, 2), ("Big", "https://d.example/feed", True, 3)]
    got = {r["feed"]: (r["content"] and len(r["content"]), r["fetch_error"]) for r in S.from_files(spark, str(tmp_path), spark.createDataFrame(rows, S.REGISTRY)).collect()}
    assert got == {"Alpha News": (10, None), "Beta": (None, "HTTP 404 from feed server"), "Gamma": (30, None), "Big": (None, S.TOO_LARGE)}


def test_retries_wait_and_slow_feeds_are_refused(spark, tmp_path):
    from sparkwire.sources import feeds as S

    log = str(tmp_path / "waits")

    def get(url):
        return (503, {}, b"") if "down" in url else (200, {}, b"x")

    def wait(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    rows = spark.createDataFrame([("Down", "https://a.example/down", True, 0)], S.REGISTRY)
    assert S.fetched(rows, get, wait).first()["fetch_error"] == "HTTP 503 from feed server"
    assert open(log).read().split() == ["1.0", "2.0"]
    slow = spark.createDataFrame([("Slow", "https://a.example/x", True, 0)], S.REGISTRY)
    now = [0.0]

    def clock():
        now[0] += 61
        return now[0]

    assert S.fetched(slow, get, wait, clock).first()["fetch_error"] == "feed took more than 60 seconds"


def test_interrupted_work_is_recovered(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.recover("r0", NOW)
    at = datetime(2026, 1, 1)
    log = [(1, "DISCOVERED", 1), (1, "ANALYZING", 2), (2, "DISCOVERED", 1), (2, "PUBLISHING", 5), (3, "DISCOVERED", 1), (3, "READY_FOR_REVIEW", 5)]
    events = spark.createDataFrame([(i, "r1", None, s, None, k, at) for i, s, k in log], "article_id long, run_id string, from_status string, to_status string, stage string, step int, created_at timestamp")
    store.commit(articles=spark.createDataFrame([(1,), (2,), (3,)], "id long"), events=events)
    for _ in range(2):
        store.recover("r2", NOW)
        assert {r["id"]: (r["status"], r["error_stage"]) for r in store.current().collect()} == {1: ("DISCOVERED", None), 2: ("FAILED", "publish_unknown"), 3: ("READY_FOR_REVIEW", None)}
    new = {r["article_id"]: (r["from_status"], r["to_status"]) for r in store.read("events").where("run_id = 'r2'").collect()}
    assert new == {1: ("ANALYZING", "DISCOVERED"), 2: ("PUBLISHING", "FAILED")} and store.read("events").count() == 8


def test_an_older_store_is_rebuilt_and_a_newer_one_refused(spark, tmp_path):
    from sparkwire import store as module

    old = tmp_path / "commits"
    spark.createDataFrame([(1, "Startups & Funding"), (2, "AI"), (3, None), (4, "Gossip")], "id long, category string").write.parquet(str(old / "c1" / "articles"))
    spark.createDataFrame([(5, "jobs")], "id long, category string").write.parquet(str(old / "c2" / "articles"))
    spark.range(7).write.parquet(str(old / "c2" / "events"))
    store = Store(spark, str(tmp_path))
    got = {r["id"]: r["category"] for r in store.read("articles").collect()}
    assert got == {1: "ENTREPRENEURSHIP", 2: "TECHNOLOGY", 3: None, 4: None, 5: "CAREER DEVELOPMENT"} and store.read("events").count() == 7
    assert store.snapshots() == [1] and store.manifest()[1]["schema"] == module.SCHEMA
    store.append("events", spark.range(2))
    assert Store(spark, str(tmp_path)).read("events").count() == 9 and store.read("events", snapshot=1).count() == 7
    number, manifest = store.manifest()
    assert store._create(number + 1, manifest | {"schema": module.SCHEMA + 1})
    with pytest.raises(module.StoreError, match="newer version"):
        store.read("events")
    with pytest.raises(module.StoreError, match="newer version"):
        store.append("events", spark.range(1))


def test_many_runs_are_one_short_listing(spark, tmp_path, monkeypatch):
    from sparkwire import store as module

    monkeypatch.setattr(module, "FOLDERS", 4)
    monkeypatch.setattr(module, "SNAPSHOTS", 3)
    store = Store(spark, str(tmp_path))
    for i in range(11):
        store.commit(runs=spark.createDataFrame([(i,)], "n long"))
    assert sorted(r["n"] for r in store.read("runs").collect()) == list(range(11))
    assert len(store.snapshots()) == 3 and len(store.manifest()[1]["tables"]["runs"]) <= 5
    assert len(list((tmp_path / "data").glob("*/runs"))) <= 12 and len(list((tmp_path / "manifest").glob("*.json"))) == 3
    assert not list((tmp_path / "manifest").glob("*.writing"))
    assert sorted(r["n"] for r in store.read("runs", snapshot=store.snapshots()[0]).collect()) == list(range(9))[: store.read("runs", snapshot=store.snapshots()[0]).count()]


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    real = a._create

    def late(number, manifest):
        a._create = real
        b.append("t", spark.range(5))  # the other writer takes the number first
        return real(number, manifest)

    a._create = late
    a.append("t", spark.range(3))
    assert a.read("t").count() == 8 and a.snapshots() == [1, 2]


def test_later_columns_are_null_in_older_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("t", spark.createDataFrame([(1,)], "n long"))
    store.append("t", spark.createDataFrame([(2, "x")], "n long, more string"))
    assert sorted(map(tuple, store.read("t").collect())) == [(1, None), (2, "x")]
