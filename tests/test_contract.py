"""The answers' contract on variants, against Python's own parser."""

import json

from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.operators import rules

GOOD = {"is_relevant": True, "category": "AI", "catchy_headline": None, "facebook_caption": "a \"b\" \n #c", "original_url": "https://x.example/", "rejection_reason": None}


def plain(text):
    def pairs(found):
        if len({k for k, _ in found}) < len(found):
            raise ValueError
        return dict(found)

    def constant(name):
        raise ValueError(name)

    try:
        d = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except (TypeError, ValueError):
        return False
    return isinstance(d, dict) and set(d) == set(vocab.ANSWER_KEYS) and isinstance(d["is_relevant"], bool) and all(v is None or isinstance(v, str) for k, v in d.items() if k != "is_relevant")


def test_contract(spark):
    good = json.dumps(GOOD)
    texts = [good, f"  {good}\n", json.dumps(GOOD, indent=2), json.dumps(dict(reversed(GOOD.items()))), json.dumps(GOOD | {"is_relevant": False}, ensure_ascii=False)]
    texts += [json.dumps(GOOD | {k: v}) for k in vocab.ANSWER_KEYS for v in (1, 1.5, True, None, "true", [], {}, [None])]
    texts += [json.dumps({k: v for k, v in GOOD.items() if k != drop}) for drop in vocab.ANSWER_KEYS] + [json.dumps(GOOD | {"extra": None}), json.dumps(GOOD | {"a: STRING, b": 1})]
    texts += ["", " ", "null", "true", "[]", "[" + good + "]", "{}", "not json", good[:-1], good + "x", good + good, good + "," + good, good + '],["x"', good + ',"x"', good + "]", good + '],[' + good, "{'is_relevant': true}"]
    texts += [good[:-1] + ', "category": "AI"}', good.replace("true", "NaN"), good.replace('"AI"', '"\t"'), good.replace('"AI"', '"\\ud83d\\ude80 é"'), "﻿" + good, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    checked = df.select("i", rules.meets_contract(F.col("t")).alias("ok"))
    got = {r["i"]: r["ok"] for r in checked.collect()}
    assert {texts[i]: ok for i, ok in got.items()} == {t: t is not None and plain(t) for t in texts}
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
