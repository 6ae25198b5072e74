"""Providers: choice, retries, outages, corrections."""

import pytest
from pyspark.sql import functions as F

from sparkwire.operators import providers
from sparkwire.operators.prompts import answer_schema
from sparkwire.operators.providers import ProviderError
from sparkwire.operators.scan import pinned
from tests.test_engine import answer


class Scripted:
    def __init__(self, *steps):
        self.steps = list(steps)

    def answer(self, prompt, schema):
        step = self.steps.pop(0)
        if isinstance(step, Exception):
            raise step
        return step


def test_choice():
    makers = {"recorded": lambda key: providers.Recorded({}), "live": lambda key: Scripted(key)}
    assert providers.chosen("recorded", makers)().answers == {}
    assert providers.chosen("live", makers, "k")().steps == ["k"]
    for name in ("other", "live"):
        with pytest.raises(providers.UnknownProvider):
            providers.chosen(name, makers)


def test_retries_are_bounded_and_for_transient_faults_only():
    waits = []
    out = ProviderError("busy", transient=True, status=503)
    assert providers.asked(Scripted(out, ProviderError("limit", True, 429, 50.0), "x"), "p", answer_schema(), waits.append) == "x" and waits == [2.0, 50.0]
    with pytest.raises(ProviderError):
        providers.asked(Scripted(out, out, out, "never"), "p", {}, waits.append)
    with pytest.raises(ProviderError):
        providers.asked(Scripted(ProviderError("bad request", status=400), "never"), "p", {}, waits.append)
    assert out.is_outage and ProviderError("no key", status=401).is_outage and not ProviderError("bad", status=400).is_outage


def test_answers_of_a_table(spark):
    rows = spark.createDataFrame([(f"u{i}", f"p{i}") for i in range(4)], "original_url string, p string").coalesce(1)
    steps = ["a0", ProviderError("bad request", status=400), ProviderError("no key", status=401)]
    got = providers.answers(rows, F.col("p"), lambda: Scripted(*steps), lambda s: None).collect()
    assert [(r["answer"], r["error"]) for r in got] == [("a0", None), (None, "ProviderError: bad request"), (None, "outage"), (None, "outage")]
    odd = providers.answers(rows.limit(1), F.col("p"), lambda: Scripted(KeyError("x")), lambda s: None).first()
    assert odd["error"] == "KeyError: 'x'"


class Improving:
    """Gives a better answer to a second question."""

    def answer(self, prompt, schema):
        url = "https://x.example/a" if "example/a" in prompt else "https://x.example/b"
        if "example/b" in prompt or "V10" in prompt:
            return answer(original_url=url)
        return answer(original_url=url, catchy_headline="Too short")


def test_one_correction(spark):
    rows = [("https://x.example/a", "Robot maker opens plant", "New.", "Wire"), ("https://x.example/b", "Robot maker opens plant", "New.", "Wire")]
    df = spark.createDataFrame(rows, "original_url string, title string, summary string, source_name string").withColumn("published_at", F.lit(None).cast("timestamp"))
    got = {r["original_url"][-1]: (r["answer"], r["correction"]) for r in providers.with_corrections(df, Improving, pinned).collect()}
    assert "Too short" in got["a"][0] and got["a"][1] == answer(original_url=rows[0][0]) and got["b"] == (answer(original_url=rows[1][0]), None)
