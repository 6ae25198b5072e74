"""Title clusters, credit, covered stories and daily slots on planted cases."""

import random
import re
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparkwire.operators import stories
from sparkwire.operators.components import components

START = datetime(2026, 3, 2)
KIND = "id long, title string, at timestamp, event_type string, entities array<string>"


def plain_clusters(rows, hours=72):
    words = {r[0]: set(re.findall(r"[^\W]+", (r[1] or "").lower())) - set(stories.COMMON_WORDS) for r in rows}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(rows, 2):
        a, b = words[x[0]], words[y[0]]
        if a and b and x[2] and y[2] and abs(x[2] - y[2]) <= timedelta(hours=hours):
            i, u = len(a & b), len(a | b)
            near = x[3] is not None and x[3] == y[3] and set(x[4] or []) & set(y[4] or [])
            if 100 * i >= 60 * u or (near and 100 * i >= 35 * u):
                p, q = sorted((find(x[0]), find(y[0])))
                root[q] = p
    return {i: find(i) for i in root}


def articles(seed, n=260):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(60)] + ["the", "of", "Ärger", "émeute"]
    heads = [" ".join(r.choices(vocab, k=r.choice([1, 2, 4, 8, 12]))) for _ in range(40)] + ["", None, "the of", "!!!"]
    rows = []
    for i in range(n):
        head = r.choice(heads)
        if head and r.random() < 0.5:
            w = head.split(" ")
            w[r.randrange(len(w))] = r.choice(vocab)
            head = " ".join(w)
        at = START + timedelta(minutes=r.choice([0, 1, 72 * 60, 72 * 60 + 1]) + 60 * r.randrange(600)) if r.random() < 0.97 else None
        rows.append((i, head, at, r.choice(["launch", "funding", None]), r.choice([["A"], ["A", "B"], [], None, ["C", "A", "A"]])))
    return rows + [(n + k, "everybody has this very headline", START + timedelta(hours=5 * k), "launch", ["A"]) for k in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, seed):
    rows = articles(seed)
    got = {r["id"]: r["cluster_id"] for r in stories.clusters(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    assert got == plain_clusters(rows)
    assert 10 < len(set(got.values())) < len(rows) - 50


def test_small_tables(spark):
    assert stories.clusters(spark.createDataFrame([], KIND)).collect() == []
    rows = [(1, "One story about robots", START, "launch", None), (2, None, START, None, None), (3, "One story about robots", START + timedelta(hours=72), None, None), (4, "One story about robots", START + timedelta(hours=145), None, None)]
    got = {r["id"]: r["cluster_id"] for r in stories.clusters(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 91), (91, 91)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(chain).collect()} == {i: 0 for i in range(51)} | {90: 90, 91: 90}


def test_credit(spark):
    rows = [(1, 3, START, "a", "x" * 9), (2, 2, START + timedelta(hours=1), "b", "short"), (3, 2, START + timedelta(hours=1), "b", "longer text"), (4, 2, None, "c", "y" * 99), (5, 1, START, None, None)]
    told = spark.createDataFrame(rows, "id long, tier int, at timestamp, publisher string, summary string")
    clustered = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)], "id long, cluster_id long")
    got = {r["cluster_id"]: (r["id"], r["publishers"], r["n_articles"], r["summary"]) for r in stories.credited(told, clustered).collect()}
    assert got == {1: (3, 3, 4, "longer text"), 5: (5, 0, 1, None)}


def test_already_covered(spark):
    told = [(1, 10, START + timedelta(days=d), follow) for d, follow in ((0, False), (7, False), (8, False), (5, True))] + [(2, 11, START, False)]
    published = spark.createDataFrame([(10, START), (10, START + timedelta(days=30))], "cluster_id long, published_at timestamp")
    df = spark.createDataFrame([(i, *x[1:]) for i, x in enumerate(told)], "id long, cluster_id long, at timestamp, follow_up boolean")
    assert sorted(r["id"] for r in stories.already_covered(df, published).collect()) == [0, 1]


def plain_slots(rows):
    out, used = [], set()
    first, last = min(r["at"] for r in rows), max(r["at"] for r in rows)
    day = first.replace(hour=0, minute=0)
    while day <= last + timedelta(days=1):
        today = []
        for h in stories.SLOTS:
            slot = day + timedelta(hours=h)
            best = None
            for r in rows:
                age = (slot - r["at"]).total_seconds() / 3600
                if r["id"] in used or not 0 <= age < 24 or r["event_type"] in stories.EXCLUDED:
                    continue
                score = (3 if age < 6 else 2 if age < 12 else 1) + (2 if r["publishers"] >= 3 else int(r["publishers"] == 2)) + (r["tier"] <= 2) + bool(r["is_major"])
                score += 2 * (r["event_type"] == "acquisition" or (r["event_type"] == "launch" and bool(r["is_major"]))) + 3 * (r["event_type"] == "security" and bool(r["is_exploited"]))
                score += (2 if (r["amount_musd"] or 0) >= 100 else int((r["amount_musd"] or 0) >= 20)) * (r["event_type"] == "funding")
                key = (score - 2 * (r["category"] in today), r["at"], -r["id"])
                if best is None or key > best[0]:
                    best = key, r
            if best:
                used.add(best[1]["id"])
                today.append(best[1]["category"])
                out.append((slot, best[1]["id"], best[0][0]))
        day += timedelta(days=1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_slots(spark, seed):
    r = random.Random(seed)
    kinds = ["launch", "funding", "acquisition", "security", "opinion", "sponsored", None]
    rows = [
        {"id": i, "cluster_id": i, "at": START + timedelta(minutes=r.randrange(8 * 1440)), "publishers": r.choice([1, 1, 2, 4]), "tier": r.choice([1, 2, 3]), "is_major": r.choice([True, False, None]), "event_type": r.choice(kinds),
         "is_exploited": r.choice([True, False]), "amount_musd": r.choice([None, 5, 20, 100]), "category": r.choice(["X", "Y"])}
        for i in range([60, 15, 300][seed])
    ]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "id long, cluster_id long, at timestamp, publishers int, tier int, is_major boolean, event_type string, is_exploited boolean, amount_musd int, category string")
    got = [(x["slot"], x["id"], x["score"]) for x in stories.slots(df).orderBy("slot").collect()]
    assert got == plain_slots(rows) and len(got) > 5
    assert stories.slots(df.where(F.lit(False))).collect() == []
