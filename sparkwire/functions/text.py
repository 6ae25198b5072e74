"""Text functions. Native expressions, but for HTML parsing and Unicode normal forms, which are pandas UDFs."""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Callable
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwire import vocab
from sparkwire.functions.urls import strip

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Visible(HTMLParser):
    """Text nodes outside dropped elements; an unclosed dropped element holds what follows up to its parent's end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not any(t in vocab.DROP_TAGS for t in self.open):
            self.parts.append(data)


class _Tidy(dict):
    """A translation that drops format characters and turns control characters into spaces."""

    def __missing__(self, code: int) -> int | str | None:
        kind = unicodedata.category(chr(code))
        self[code] = None if kind == "Cf" else " " if kind == "Cc" and code < 128 else code
        return self[code]


_TIDY = _Tidy()
_ESCAPED_TAG = re.compile(r"&lt;\s*/?\s*[a-zA-Z]")


def _rendered(markup: str) -> str:
    parser = _Visible()
    parser.feed(markup)
    parser.close()
    return " ".join(parser.parts)


def plain_text(raw: str | None) -> str:
    """Readable text of untrusted HTML, which may be escaped once; references are decoded twice at most.

    Only the first ``RAW_HTML_CHARS`` characters of a feed's summary count: a fixed limit of the data model.
    """
    markup = (raw or "")[: vocab.RAW_HTML_CHARS]
    if "<" not in markup and _ESCAPED_TAG.search(markup):
        markup = entities.unescape(markup)
    text = _rendered(markup) if "<" in markup else markup
    text = entities.unescape(entities.unescape(text))
    return " ".join(unicodedata.normalize("NFC", text).translate(_TIDY).split())


@F.pandas_udf(T.StringType())
def html_to_text(raw: pd.Series) -> pd.Series:
    return raw.map(plain_text)


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def truncate(text: Column, most: int) -> Column:
    """Cut at a word's end where that keeps over 60 %, and mark the cut with an ellipsis."""
    cut = F.substring(text, 1, most - 1)
    back = F.locate(" ", F.reverse(cut))
    space = F.length(cut) - back
    cut = F.when((back > 0) & (space > most * 0.6), F.substring(text, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:-]+$", ""), F.lit("…")))


def clean_title(raw: Column) -> Column:
    return truncate(html_to_text(raw), vocab.TITLE_CHARS)


def without_boilerplate(text: Column) -> Column:
    """Without the phrases that feeds put at a summary's end."""
    for pattern in vocab.TRAILING_BOILERPLATE:
        text = strip(F.regexp_replace(text, pattern, ""))
    return text


def clean_summary(raw: Column) -> Column:
    return truncate(without_boilerplate(html_to_text(raw)), vocab.SUMMARY_CHARS)


def title_fingerprint(title: Column) -> Column:
    """SHA-256 of the title's folded words, null below six words."""
    words = F.regexp_extract_all(folded(title), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.when(F.size(words) >= vocab.FINGERPRINT_WORDS, F.sha2(F.array_join(words, " "), 256))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized_headline(text: Column) -> Column:
    h = collapsed(text)
    inner = F.substring(h, F.lit(2), F.length(h) - 2)
    quoted = (F.length(h) >= 2) & h.rlike("""^["'“‘]""") & h.rlike("""["'”’]$""")
    h = F.when(quoted, F.trim(inner)).otherwise(h)
    return F.when(h.endswith(".") & ~h.endswith(".."), F.rtrim(F.regexp_replace(h, r"\.$", ""))).otherwise(h)


def without_markers(text: Column) -> Column:
    return F.regexp_replace(text, "<{2,}|>{2,}", " ")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def comment_text(url: Column) -> Column:
    return F.concat(F.lit(vocab.COMMENT_PREFIX), url)


@cache
def _single_uppers() -> tuple[str, str]:
    """Letters that have one letter as their upper case, and those letters in the same order."""
    one = {c: next((u for u in (c.upper(), c.title()) if len(u) == 1), c) for c in map(chr, range(0x20000))} | {"ß": "ẞ"}
    changed = [c for c in one if one[c] != c]
    return "".join(changed), "".join(one[c] for c in changed)


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter, as DuckDB has it: ß becomes ẞ and a ligature stays, where ``F.upper`` makes SS and FI of them."""
    return F.translate(text, *_single_uppers())


def category_key(label: Column, upper: Callable[[Column], Column] = F.upper) -> Column:
    text = F.regexp_replace(F.replace(upper(label), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9 ]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def category(label: Column, upper: Callable[[Column], Column] = F.upper) -> Column:
    """One of five categories, or null."""
    pairs = [x for c, names in vocab.CATEGORY_ALIASES.items() for a in (c, *names) for x in (F.lit(a), F.lit(c))]
    return F.try_element_at(F.create_map(*pairs), category_key(label, upper))


def token_fingerprint(token: Column) -> Column:
    return F.substring(F.sha2(token, 256), 1, 10)


def tagline(text: Column) -> Column:
    return F.substring(F.upper(text), 1, 28)


def redact(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    for s in sorted({s for s in secrets if len(s) >= 6}, key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    for pattern, by in vocab.SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", by))
    return text


def short_error(text: Column, most: int = 300) -> Column:
    return F.substring(redact(text), 1, most)


HASHTAG = r"(?U)(?<!\w)#[\p{L}]\w*"


def without_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, HASHTAG, " ")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*"), 0)


def unsupported_numbers(copy: Column, source: Column) -> Column:
    known = F.transform(numbers(source), lambda n: F.replace(n, F.lit(","), F.lit("")))
    found = F.filter(numbers(without_hashtags(copy)), lambda n: ~F.array_contains(known, F.replace(n, F.lit(","), F.lit(""))))
    return F.array_sort(F.array_distinct(found))


def unsupported_domains(copy: Column, source: Column) -> Column:
    found = F.regexp_extract_all(without_hashtags(copy), F.lit(r"(?i)\b(?:[a-z0-9-]+\.)+[a-z]{2,24}\b"), 0)
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: ~F.contains(F.lower(source), F.lower(d)))))


def format_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def card_file(url_hash: Column, published: Column, discovered: Column) -> Column:
    """The card's name, from its date and hash only; null where the hash is no hash."""
    name = F.concat(F.date_format(F.coalesce(published, discovered), "yyyy-MM-dd"), F.lit("_"), F.substring(url_hash, 1, 16), F.lit(".jpg"))
    return F.when(url_hash.rlike("^[0-9a-f]{16,64}$"), name)
