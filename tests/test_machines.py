"""The streams with keyed state against the batch operators, over several micro-batches and restarts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkwire.operators import dedup, fold
from sparkwire.plans import catalog
from sparkwire.streaming import machines
from tests.test_fold import KIND, history

SF = "/root/testdata/sf0.001"
KEYS = ["event_id", "before", "stage_before", "recovered", "accepted", "after", "stage_after"]


@pytest.fixture(autouse=True)
def rocksdb(spark):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    machines.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def run(stream, folder: Path, one_batch_each=True):
    q = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def put(df, folder: Path, n: int):
    df.coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_states_in_batches_and_after_restarts(spark, tmp_path):
    events = [e for e in history(600, range(5), 11) if e[1] is not None]
    kind = ", ".join(KIND.split(", ")[:6])
    at = events[0][5]
    events += [(k, a, None, to, None, at, "") for k, (a, to) in enumerate([(50, "DISCOVERED"), (50, "ANALYZING"), *((51, s) for s in ("DISCOVERED", "ANALYZING", "APPROVED", "IMAGE_CREATED", "READY_FOR_REVIEW", "PUBLISHING"))], -10)]
    df = spark.createDataFrame([e[:6] for e in events], kind)
    (tmp_path / "in").mkdir()
    source = lambda: machines.article_states(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    put(df.where("event_id < 150"), tmp_path, 0)
    run(source(), tmp_path)  # a run of its own: the next one starts from the checkpoint
    put(df.where("event_id between 150 and 399"), tmp_path, 1)
    run(source(), tmp_path)
    put(df.where("event_id >= 400"), tmp_path, 2)
    run(source(), tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {tuple(r) for r in out.where("event_id is not null").select(KEYS).collect()}
    want = {tuple(r) for r in fold.replay(df, lease_minutes=30).select(KEYS).collect()}
    assert got == want and len(want) == len(events) and any(r[3] for r in want)
    # timers tell of articles that are left; each has been in one of the two states
    timers = out.where("event_id is null").collect()
    kinds = {("ANALYZING", "DISCOVERED", None), ("PUBLISHING", "FAILED", "publish_unknown")}
    assert {(r["before"], r["after"], r["stage_after"]) for r in timers} == kinds and {50, 51} <= {r["article_id"] for r in timers}
    assert all((r["at"] - at).total_seconds() >= 1800 for r in timers)


def test_states_of_three_batches_in_one_run(spark, tmp_path):
    events = history(300, range(3), 12)
    df = spark.createDataFrame([e[:6] for e in events], ", ".join(KIND.split(", ")[:6]))
    for k in range(3):
        put(df.where(f"event_id between {100 * k} and {100 * k + 99}"), tmp_path, k)
        import os
        import time

        for p in (tmp_path / "in").glob("*.parquet"):  # files are read in the order of their times
            if not p.name.startswith("done"):
                name = p.with_name(f"done-{k}.parquet")
                p.rename(name)
                at = time.time() - 100 + k
                os.utime(name, (at, at))
    q = run(machines.article_states(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), tmp_path)
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("event_id is not null").select(KEYS).collect()}
    assert got == {tuple(r) for r in fold.replay(df, lease_minutes=30).select(KEYS).collect()}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_twins_equal_same_story_on_documents(spark, tmp_path):
    at = F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(0, int(doc_id % 1000))")
    docs = catalog.title_fingerprint(spark, SF).select(F.col("doc_id").alias("id"), "title_fingerprint", at.alias("discovered_at"))
    # more twins than the table has: every tenth headline again, three times and in other weeks
    again = docs.where("id % 10 = 0")
    more = [again.select((F.col("id") + 1000 * k).alias("id"), "title_fingerprint", (F.col("discovered_at") + F.expr(f"interval {days} days")).alias("discovered_at")) for k, days in ((1, 0), (2, 7), (3, 9), (4, 17))]
    for m in more:
        docs = docs.unionByName(m)
    docs = docs.where("title_fingerprint is not null")
    cuts = ["discovered_at < '2026-01-05'", "discovered_at >= '2026-01-05' and discovered_at < '2026-01-09 12:00:00'", "discovered_at >= '2026-01-09 12:00:00'"]
    (tmp_path / "in").mkdir()
    for k, cut in enumerate(cuts):
        put(docs.where(cut), tmp_path, k)
        run(machines.headline_twins(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))), tmp_path)
    got = {(r["id"], r["twin_of"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["id"], r["twin_of"], "DISCOVERED" if r["twin_of"] is None else "REJECTED") for r in dedup.same_story(docs).collect()}
    assert got == want and sum(r[1] is not None for r in want) > 20
