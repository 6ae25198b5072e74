"""The feed scan as a data source: a partition for each feed, error rows, polls as a stream."""

from pathlib import Path

from sparkwire.sources import feeds as S
from sparkwire.sources import scan
from tests.test_engine import item, rss

FEEDS = [S.Feed(f"f{i}", f"https://f{i}.example/feed.xml", i != 7) for i in range(41)]
BODY = rss(item("A", "https://x.example/a"))


def get(url):
    if "f3.example" in url:
        raise TimeoutError
    if "f5.example" in url:
        raise ValueError(url)
    if "f6.example" in url:
        return 404, {}, b""
    return 200, {}, BODY


def still(seconds):
    pass


def test_a_partition_for_each_feed(spark):
    df = scan.documents(spark, FEEDS, S.Fetcher(get, still))
    assert df.rdd.getNumPartitions() == 40  # one feed is not enabled
    rows = {r["feed"]: r for r in df.collect()}
    assert len(rows) == 40 and {k: r["fetch_error"] for k, r in rows.items() if r["fetch_error"]} == {"f3": "timed out", "f5": "invalid URL", "f6": "HTTP 404 from feed server"}
    assert bytes(rows["f8"]["content"]) == BODY and rows["f8"]["ordinal"] == 8
    entries = S.entries(df)
    assert entries.where("error is null").count() == 37 and entries.where("error is not null").count() == 3


def test_no_feeds(spark):
    assert scan.documents(spark, [], S.Fetcher(get, still)).collect() == []


def test_one_failing_feed_is_one_error_row(spark):
    df = scan.documents(spark, [f for f in FEEDS if f.name in ("f2", "f3", "f4")], S.Fetcher(get, still))
    assert [r["feed"] for r in df.where("fetch_error is not null").collect()] == ["f3"] and df.count() == 3


def test_polls(spark, tmp_path):
    clock = tmp_path / "clock"
    clock.write_text("1000")
    now = lambda: float(clock.read_text())  # noqa: E731 - read by the driver and by the stream's own process

    def poll(at):
        clock.write_text(str(at))
        q = scan.document_stream(spark, FEEDS[:4], S.Fetcher(get, still), every=100, now=now).writeStream.format("parquet")
        q = q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        q.awaitTermination()

    for at in (1000, 1050, 1150, 1500):  # the second one lies in the first one's interval
        poll(at)
    got = sorted((r["poll"], r["feed"], r["fetch_error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(p, f"f{i}", "timed out" if i == 3 else None) for p in (10, 11, 15) for i in range(4)]
    assert Path(tmp_path / "state").exists()
