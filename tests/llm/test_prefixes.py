"""The prefix trie against a plain trie and against its SQL."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest

from sparkwire.llm import prefixes
from sparkwire.llm.queries import oracle_sql, queries
from sparkwire.llm.scratch import Scratch

KIND = "conv_id long, turn long, role string, text string, node int, depth string"


def plain(rows):
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((t is not None, t or 0), role, digest, text))
    turns = {c: [(role, text) for _, role, _, text in sorted(x)] for c, x in convs.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in members}
    out = []
    for p, cs in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        ends = ",".join(str(c) for c in sorted(cs) if paths[c] == p)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), sum(not children[q] for q in below[p]), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=repr)


def conversations(seed=3):
    r = random.Random(seed)
    rows, words = [], ["a", "bb", "é", "", None, "hello there"]
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        for t in range(r.choice([0, 1, 3, 12, 20])):
            rows.append((c, r.choice([t, t, t, 2, None]), r.choice(["user", "assistant", None, ""]), r.choice(words)))
    rows += [(200 + k, t, "user", "same") for k in range(120) for t in range(6)]  # copies
    rows += [(61, 4, "user", "again")] * 5 + [(None, 1, "user", "x"), (62, None, None, None), (63, 0, "user", "long " * 40000)]
    rows += [(70, t, "user", f"turn {t}") for t in range(250)]  # a conversation that holds many rows
    r.shuffle(rows)
    return [(*x, 1, "clash") for x in rows]


def test_equals_a_plain_trie(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert got(prefixes.trie(df, Scratch(spark, "t"))) == plain(rows)


def test_small_cases(spark):
    for rows in ([(5, 0, "user", "x")], [(None, 0, "user", "x")], [(6, 0, "u", "x"), (5, 0, "u", "x"), (7, None, None, None)], [(0, 1, "ab", "c"), (1, 1, "a", "bc"), (2, 1, "", "abc")]):
        df = spark.createDataFrame([(*x, 1, "clash") for x in rows], KIND)
        assert got(prefixes.trie(df, Scratch(spark, "t"))) == plain(rows)
    assert got(prefixes.trie(spark.createDataFrame([], KIND), Scratch(spark, "t"))) == []


def test_a_collision_stops_the_query(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(prefixes, "_node", lambda depth, limbs: F.unhex(F.sha2(depth.cast("string"), 256)))
    df = spark.createDataFrame([(5 * k, 0, "user", f"{k}", 1, "") for k in range(9)], KIND)
    with pytest.raises(Exception, match="two prefixes with one hash"):
        prefixes.trie(df, Scratch(spark, "t")).collect()


def test_query_and_sql(spark, tmp_path):
    rows = [x for x in conversations(8) if x[0] != 70 and len(x[3] or "") < 1000]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, KIND).drop("node", "depth").write.parquet(path)
    df = queries()["op12_prefix_trie"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/*.parquet'")
    r = con.execute(oracle_sql()["op12_prefix_trie"])
    assert sorted(d[0] for d in r.description) == sorted(df.columns)
    order = [[d[0] for d in r.description].index(c) for c in COLUMNS]
    want = sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)
    assert got(df) == want == plain(rows)
