"""Running sums and the fates of a run's list against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwire.operators import scan, schedule


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_running_sums(spark, partitions):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", None, "b"]), r.choice([1, 2, 3, None]), i, r.choice([0, 1, None, 5])) for i in range(700)] + [("a", 2, 9999, 1)] * 40
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(3)
        got = scan.running(df, [F.col("t").desc_nulls_first(), F.col("i")], {"n": F.lit(1).cast("long"), "s": F.col("v").cast("long")}, key=("k",)).collect()
        whole = scan.running(df, [F.col("i")], {"n": F.lit(1).cast("long")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, held = [], {}
    for k, t, i, v in sorted(rows, key=lambda x: (x[1] is not None, -(x[1] or 0), x[2])):
        n, s = held.get(k, (0, 0))
        want.append((k, t, i, v, n, s))
        held[k] = n + 1, s + (v or 0)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sorted(x["n"] for x in whole) == list(range(len(rows)))
    assert scan.running(df.limit(0), [F.col("i")], {"n": F.lit(1)}).collect() == []


def plain(rows, limit):
    """rows: (id, resumed, needs, outage, duplicate, twin) in order."""
    out, used, stopped, over = {}, 0, False, False
    for i, resumed, needs, outage, duplicate, twin in rows:
        if used >= limit:
            over = True
        if over:
            out[i] = "next_run"
        elif resumed and stopped and needs:
            out[i] = "skipped"
        elif not resumed and stopped:
            out[i] = "not_registered"
        elif not resumed and duplicate:
            out[i] = "duplicate"
        elif not resumed and twin:
            out[i] = "same_story"
        else:
            used += 1
            out[i] = "returned" if needs and outage and not stopped else "worked"
            stopped = stopped or (needs and outage)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_run_fates(spark, seed):
    r = random.Random(seed)
    flags = [(i, r.random() < 0.7, r.random() < [0.02, 0.0, 0.3, 0.01][seed], r.random() < 0.2, r.random() < 0.2, r.choice("xyyyy"), 1000 - r.randrange(900)) for i in range(300)]
    df = spark.createDataFrame([(*f, i < 80) for i, f in enumerate(flags)], "id long, needs boolean, outage boolean, dup boolean, twin boolean, source string, t long, old boolean").withColumn("at", F.timestamp_seconds("t"))
    limit = [100, 40, 500, 90][seed]
    work = schedule.run_list(df.where("old"), df.where("not old"), "source", "at", "id")
    got = {x["id"]: x["fate"] for x in schedule.run_fates(work, limit, F.col("outage"), F.col("needs"), F.col("dup"), F.col("twin")).collect()}
    resumed = sorted(flags[:80], key=lambda f: (-f[6], f[0]))
    rounds = {}
    for source in "xy":
        for k, f in enumerate(sorted((f for f in flags[80:] if f[5] == source), key=lambda f: (-f[6], f[0]))):
            rounds[f[0]] = k
    fresh = sorted(flags[80:], key=lambda f: (rounds[f[0]], -f[6], f[0]))
    order = [(f[0], True, f[1], f[2], f[3], f[4]) for f in resumed] + [(f[0], False, f[1], f[2], f[3], f[4]) for f in fresh]
    assert got == plain(order, limit)
