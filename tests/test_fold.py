"""The state machine's fold against a plain loop, with histories that cross partitions."""

import random

import pytest

from sparkwire import vocab
from sparkwire.operators import fold, state

KIND = "event_id long, article_id long, from_status string, to_status string, stage string, created_at timestamp, start string, accepted string"


def plain(events, lease=None):
    held, out = {}, {}
    for e in sorted(events, key=lambda e: (e[1] is not None, e[1] or 0, e[0])):
        i, article, seen, to, stage, at, *_ = e
        status, failed, last = held.get(article, (None, None, at))
        recovered = False
        if lease is not None and (at - last).total_seconds() > 60 * lease and status in ("ANALYZING", "PUBLISHING"):
            status, failed = ("DISCOVERED", None) if status == "ANALYZING" else ("FAILED", "publish_unknown")
            recovered = True
        before = status, failed
        ok = to in vocab.STATUSES and (seen is None or seen == status) and fold.allowed(status, failed, to)
        if ok:
            status, failed = to, stage if to == "FAILED" and stage in vocab.STAGES else None
        held[article] = status, failed, at
        out[i] = (*before, recovered, ok, status, failed)
    return out


def history(n, articles, seed):
    from datetime import datetime, timedelta

    r, at, events, held = random.Random(seed), datetime(2026, 1, 1), [], {}
    for i in range(n):
        at += timedelta(minutes=r.choice([0, 1, 5, 20, 70]))
        article = r.choice([*articles, articles[0], articles[0], articles[0]])
        likely = [b for a, b, _ in vocab.TRANSITIONS if a == held.get(article)] or ["DISCOVERED"]
        to = r.choice([*likely, *likely, *likely, r.choice(vocab.STATUSES), "NOT_A_STATE"])
        events.append((i, article, r.choice([None, None, None, held.get(article), r.choice(vocab.STATUSES), "GONE"]), to, r.choice([*vocab.STAGES, None, "odd"]), at, "clash", "old"))
        if to in vocab.STATUSES and r.random() < 0.8:
            held[article] = to
    return events


@pytest.mark.parametrize("lease", [None, 30])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_replay(spark, lease, partitions):
    events = history(1500, [*range(6), None], 4)
    assert sum(e[1] == 0 for e in events) > 400  # crosses several borders
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = fold.replay(spark.createDataFrame(events, KIND).repartition(3), lease_minutes=lease)
        got = {r["event_id"]: (r["before"], r["stage_before"], r["recovered"], r["accepted"], r["after"], r["stage_after"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain(events, lease)
    assert got == want
    assert {v[3] for v in want.values()} == {True, False} and (lease is None or any(v[2] for v in want.values()))
    assert [f.name for f in df.schema][: len(events[0]) - 1] == KIND.replace(",", "").split()[:-2:2]


def test_empty_log(spark):
    assert fold.replay(spark.createDataFrame([], KIND)).collect() == []


def test_a_refused_event_leaves_the_state(spark):
    """The loser of a race is refused, and a valid event after it is not."""
    log = [(None, "DISCOVERED"), ("DISCOVERED", "ANALYZING"), ("DISCOVERED", "REJECTED"), ("ANALYZING", "APPROVED")]
    df = spark.createDataFrame([(i, 1, a, b) for i, (a, b) in enumerate(log)], "event_id long, article_id long, from_status string, to_status string")
    assert [r["accepted"] for r in fold.replay(df).orderBy("event_id").collect()] == [True, True, False, True]
    assert [r["event_id"] for r in state.lost_updates(df).collect()] == [2]


def test_budget_counts_accepted_failures_only(spark):
    path = [(None, "DISCOVERED"), (None, "ANALYZING"), (None, "FAILED"), (None, "FAILED"), (None, "ANALYZING"), (None, "FAILED"), ("APPROVED", "FAILED")]
    df = spark.createDataFrame([(i, 1, a, b, "analyze" if b == "FAILED" else None) for i, (a, b) in enumerate(path)], "event_id long, article_id long, from_status string, to_status string, stage string")
    [r] = state.folded(df).collect()
    assert (r["status"], r["error_stage"], r["retry_count"]) == ("FAILED", "analyze", 2)
