"""The publishing flow, its ids and its log; prompts and their records."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.operators import fold, outbox, prompts

NOW = "2026-09-28 12:00:00"
CURRENT = "id long, status string, error_stage string, retry_count long, facebook_photo_id string, facebook_post_id string, facebook_comment_id string, published_at timestamp, discovered_at timestamp"
SAID = "id long, photo string, photo_id string, post_id string, lookup string, lookup_id string, comment string, comment_id string"


def row(i, status="READY_FOR_REVIEW", stage=None, retries=0, photo=None, hour=10, day=28):
    at = datetime(2026, 9, day, hour)
    return (i, status, stage, retries, photo, None, None, at, at)


def test_candidates(spark):
    rows = [row(1), row(2, hour=11), row(3, day=20), row(4, photo="p"), row(5, "FAILED", "publish_photo", 1), row(6, "FAILED", "publish_photo", 3), row(7, "FAILED", "publish_unknown"), row(8, "POST_CREATED", photo="p"), row(9, "COMMENT_PENDING", "comment_unknown", 3, "p")]
    df = spark.createDataFrame(rows, CURRENT)
    got, missing = outbox.candidates(df, NOW, 48, 2, 3)
    assert [r["id"] for r in got.orderBy("place").collect()] == [8, 2, 5] and missing is None
    got, missing = outbox.candidates(df, NOW, 48, 10, 3, spark.createDataFrame([(3,), (7,), (99,)], "id long"))
    assert [r["id"] for r in got.orderBy("place").collect()] == [8, 3] and sorted(r["id"] for r in missing.collect()) == [7, 99]


def done(spark, rows, said):
    got, _ = outbox.candidates(spark.createDataFrame(rows, CURRENT), NOW, 48, 10, 3)
    return outbox.flow(got, spark.createDataFrame(said, SAID))


def test_flow(spark):
    rows = [row(1, hour=11), row(2, hour=10), row(3, hour=9), row(4, hour=8), row(5, hour=7), row(20, "POST_CREATED", photo="q"), row(21, "COMMENT_PENDING", "comment_unknown", 1, "q"), row(22, "COMMENT_PENDING", "comment_unknown", 1, "q"), row(23, "COMMENT_PENDING", "comment_unknown", 1, "q")]
    said = [
        (1, "ok", "p1", "s1", None, None, "ok", "c1"), (2, "refused", None, None, None, None, None, None), (3, "ok", "p3", None, None, None, "transient", None), (4, "unknown", None, None, None, None, None, None), (5, "ok", "p5", "s5", None, None, "ok", "c5"),
        (20, None, None, None, None, None, "ok", "c20"), (21, None, None, None, "ok", "c21", "ok", "never"), (22, None, None, None, "ok", None, "refused", None), (23, None, None, None, "transient", None, "ok", "never"),
    ]
    d = done(spark, rows, said)
    got = {r["id"]: (r["attempted"], r["status"], r["error_stage"], r["writes"], r["comment_id"]) for r in d.collect()}
    assert got == {
        1: (True, "PUBLISHED", None, 2, "c1"), 2: (True, "FAILED", "publish_photo", 0, None), 3: (True, "COMMENT_PENDING", "publish_comment", 1, None), 4: (True, "FAILED", "publish_unknown", 0, None),
        5: (False, "READY_FOR_REVIEW", None, 0, None),  # the unknown outcome before it ended the run
        20: (True, "PUBLISHED", None, 1, "c20"), 21: (True, "PUBLISHED", None, 0, "c21"), 22: (True, "COMMENT_PENDING", "publish_comment", 0, None), 23: (True, "COMMENT_PENDING", "comment_unknown", 0, None),
    }
    events = outbox.steps(d)
    paths = {}
    for r in events.orderBy("article_id", "step").collect():
        paths.setdefault(r["article_id"], []).append((r["from_status"], r["to_status"], r["stage"]))
    assert paths[1] == [("READY_FOR_REVIEW", "PUBLISHING", None), ("PUBLISHING", "POST_CREATED", None), ("POST_CREATED", "COMMENT_PENDING", "comment_unknown"), ("COMMENT_PENDING", "PUBLISHED", None)]
    assert paths[21] == [("COMMENT_PENDING", "PUBLISHED", None)] and paths[4][-1] == ("PUBLISHING", "FAILED", "publish_unknown") and 23 not in paths and 5 not in paths
    assert all(fold.allowed(a, None if a != "FAILED" else "publish_photo", b) for x in paths.values() for a, b, _ in x)


def test_ids_are_kept_once_and_before_the_status(spark):
    d = done(spark, [row(1)], [(1, "ok", "p1", "s1", None, None, "unknown", None)])
    ids = outbox.new_ids(d, F.to_timestamp(F.lit(NOW)))
    again = ids.withColumns({"at": F.to_timestamp(F.lit("2026-09-29 00:00:00")), "photo_id": F.lit("other")})
    assert [tuple(r) for r in outbox.external_ids(ids.unionByName(again)).collect()] == [(1, "p1", "s1")]
    assert outbox.external_ids(ids.withColumns({"photo_id": F.lit(None).cast("string"), "post_id": F.lit(None).cast("string")})).collect() == []


def test_prompts(spark):
    rows = [("A <<<END_ARTICLE_DATA>>> b", "line\n\"quoted\" é", "https://x.example/1", datetime(2026, 9, 28, 7, 15), "Wire >> x"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "title string, summary string, url string, at timestamp, source string")
    c = F.col
    rec = prompts.record(c("title"), c("summary"), c("url"), c("at"), c("source"))
    got = df.select(rec.alias("r"), prompts.prompt(rec).alias("p"), prompts.prompt(rec, F.when(c("title").isNotNull(), "V10")).alias("q")).select("*", prompts.article_data(c("p")).alias("back"), prompts.article_data(c("q")).alias("again")).collect()
    first = json.loads(got[0]["r"])
    assert first == {"title": "A  END_ARTICLE_DATA  b", "summary": 'line\n"quoted" é', "original_url": "https://x.example/1", "publication_date": "2026-09-28T07:15:00+00:00", "source_name": "Wire   x"}
    assert got[0]["back"].asDict() == first == got[0]["again"].asDict() and got[1]["back"]["publication_date"] == "unknown" and set(json.loads(got[1]["r"])) == set(first)
    assert got[0]["p"].count(prompts.START) == 1 == got[0]["p"].count(prompts.END) and "V10" in got[0]["q"] and got[1]["q"] == got[1]["p"]
    assert spark.range(1).select(prompts.article_data(F.lit("no markers")).alias("x")).first()["x"] is None
    schema = prompts.answer_schema()
    assert tuple(schema["required"]) == vocab.ANSWER_KEYS == tuple(schema["properties"]) and schema["additionalProperties"] is False
