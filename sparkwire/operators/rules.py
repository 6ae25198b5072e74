"""The ordered rules an answer has to pass; the first breach is its verdict, V01 to V27."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.functions import text as X
from sparkwire.functions.urls import strip

_URL = r"(?i)(https?://|www\.)"
ANSWER = "is_relevant boolean, category string, catchy_headline string, facebook_caption string, original_url string, rejection_reason string"


#: An object as Spark describes it: its keys in order, each with its type; VOID is a JSON null.
_CONTRACT = "^OBJECT<" + ", ".join(f"{k}: " + ("BOOLEAN" if k == "is_relevant" else "(STRING|VOID)") for k in sorted(vocab.ANSWER_KEYS)) + ">$"


def meets_contract(raw: Column) -> Column:
    """One JSON object with exactly the six keys, a real boolean, and strings or null: types are never coerced, a key that stands twice is a breach.

    The parser would overlook what follows a value. So the text is put in a list, before a second entry that it can't know, its own hash: only if the
    text is one whole value, that entry is the list's second one.
    """
    mark = F.sha2(raw, 256)
    parsed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), mark, F.lit('"]')))
    whole = F.try_variant_get(parsed, "$[1]", "string") == mark
    return F.coalesce(whole & F.schema_of_variant(F.try_variant_get(parsed, "$[0]", "variant")).rlike(_CONTRACT), F.lit(False))


@cache
def _latin_letters() -> str:
    """A character class of the letters whose Unicode name begins with LATIN."""
    found = [c for c in range(0x20000) if chr(c).isalpha() and unicodedata.name(chr(c), "").startswith("LATIN")]
    ranges, start = [], found[0]
    for a, b in zip(found, [*found[1:], -1], strict=True):
        if b != a + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{a:x}}}")
            start = b
    return "".join(ranges)


def leaks(text: Column) -> Column:
    return text.rlike(vocab.LEAK) | text.rlike(vocab.REFUSAL)


def _first(*checks: tuple[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), code) for code, c in checks], F.lit(None).cast("string"))


def headline_rule(h: Column, upper: Callable[[Column], Column] = F.upper) -> Column:
    """Of a normalised headline."""
    words = F.split(h, " ")
    low, high = vocab.HEADLINE_WORDS
    lettered = F.filter(words, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2)
    loud = F.filter(lettered, lambda w: (w == upper(w)) & (w != F.lower(w)))
    return _first(
        ("V09", h == ""),
        ("V10", (F.size(words) < low) | (F.size(words) > high)),
        ("V11", F.length(h) > vocab.HEADLINE_CHARS),
        ("V12", h.rlike(_URL)),
        ("V13", h.rlike(X.HASHTAG)),
        ("V14", (F.length(h) - F.length(F.replace(h, F.lit("!"), F.lit(""))) > 1) | h.rlike(r"\?!|!\?|\?\?")),
        ("V15", (F.size(lettered) >= 4) & (F.size(loud) / F.size(lettered) > 0.6)),
        ("V16", h.rlike(rf"[\p{{L}}&&[^{_latin_letters()}]]")),
        ("V17", h.rlike(r"[^\p{L}\p{Nd}\p{Zs}\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}\p{Sc}\p{Sm}]")),
    )


def caption_rule(c: Column) -> Column:
    """Of a stripped caption."""
    low, high = vocab.CAPTION_CHARS
    least, most = vocab.CAPTION_HASHTAGS
    tail = F.regexp_extract(c, r"(?U)((?:\s+#\p{L}\w*)+\s*)$", 1)
    body = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
    tags = F.size(F.regexp_extract_all(tail, F.lit(X.HASHTAG), 0))
    return _first(
        ("V18", c == ""),
        ("V19", c.rlike(r"\p{Cf}")),
        ("V20", (F.length(c) < low) | (F.length(c) > high)),
        ("V21", c.rlike(_URL)),
        ("V22", body.rlike(X.HASHTAG)),
        ("V23", (tags < least) | (tags > most)),
        ("V24", strip(body) == ""),
    )


def verdict(answers: DataFrame, raw: str = "answer", upper: Callable[[Column], Column] = F.upper) -> DataFrame:
    """answers, with title, summary, source_name and original_url of their article, and: ``rule`` (null: passed),
    ``outcome`` (approved, rejected or invalid), ``category``, ``headline``, ``caption``, ``reason``. ``upper`` is the upper case of V06 and V15."""
    text = strip(F.coalesce(raw, F.lit("")))
    parsed = answers.withColumn("_t", text).withColumn("_a", F.from_json("_t", ANSWER))
    a = F.col("_a")
    reason = X.collapsed(F.coalesce(a["rejection_reason"], F.lit("")))
    headline, caption = X.normalized_headline(F.coalesce(a["catchy_headline"], F.lit(""))), strip(F.coalesce(a["facebook_caption"], F.lit("")))
    parsed = parsed.withColumns({"_ok": meets_contract(text), "reason": reason, "headline": headline, "caption": caption})
    h, c = F.col("headline"), F.col("caption")
    source = F.concat_ws(" ", "title", "summary")
    copy = F.concat_ws(" ", h, c)
    relevant = a["is_relevant"]
    before = _first(("V01", F.col("_t") == ""), ("V02", F.contains("_t", F.lit("```"))), ("V03", ~F.col("_ok")))
    refused = _first(("V04", F.col("reason") == ""), ("V05", leaks(F.col("reason"))))
    kept = F.coalesce(
        _first(
            ("V06", X.category(a["category"], upper).isNull()),
            ("V07", strip(F.coalesce(a["original_url"], F.lit(""))) != F.col("original_url")),
            ("V08", leaks(h) | leaks(c)),
        ),
        headline_rule(h, upper),
        caption_rule(c),
        _first(
            ("V25", F.size(X.unsupported_numbers(copy, source)) > 0),
            ("V26", h.rlike(vocab.ADVICE) | c.rlike(vocab.ADVICE)),
            ("V27", F.size(X.unsupported_domains(copy, F.concat_ws(" ", source, "source_name", "original_url"))) > 0),
        ),
    )
    out = parsed.withColumn("rule", F.coalesce(before, F.when(relevant, kept).otherwise(refused)))
    passed = F.col("rule").isNull()
    return out.withColumns({
        "outcome": F.when(~passed, "invalid").when(relevant, "approved").otherwise("rejected"),
        "category": F.when(passed & relevant, X.category(a["category"], upper)),
        "headline": F.when(passed & relevant, h),
        "caption": F.when(passed & relevant, c),
        "reason": F.when(passed & ~relevant, F.substring("reason", 1, vocab.REASON_CHARS)),
    }).drop("_t", "_a", "_ok")


def corrected(first: DataFrame, second: DataFrame, key: str = "original_url") -> DataFrame:
    """One correction round: where the first verdict is invalid, the second one counts."""
    again = second.join(first.where("outcome = 'invalid'").select(key), key, "left_semi")
    return first.join(again.select(key), key, "left_anti").unionByName(again)
