"""RSS and Atom entries by Spark's own XML functions: no Python worker reads a document.

A whole document is parsed by ``from_xml`` into the three places where entries stand (RSS 2.0, RSS 1.0, Atom). A document that breaks off or has a fault is read
entry by entry up to the first one that does not parse. Documents that declare entities are refused.

It gives what :func:`sparkwire.sources.feeds.entries` gives, but for two things that the cleaning of titles and summaries makes equal: markup that is nested as XML (not escaped or in CDATA) stays
in the texts, and element names are taken in their usual case. Everything about one document happens in its row: a feed has 10 MB at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true", "valueTag": "_VALUE", "attributePrefix": "_"}
_TEXTS = ("title", "creator", "summary", "description", "encoded", "content", "pubDate", "published", "date", "updated", "created")
_FIELDS = (
    ", ".join(f"{c}: array<struct<_VALUE: string>>" for c in ("guid", "id")) + ", " + ", ".join(f"{c}: array<string>" for c in _TEXTS)
    + ", link: array<struct<_VALUE: string, _href: string, _rel: string>>, author: array<struct<_VALUE: string, name: string>>"
)
_ENTRY = f"struct<{_FIELDS}>"
_DOCUMENT = f"struct<channel: struct<language: array<string>, item: array<{_ENTRY}>>, item: array<{_ENTRY}>, entry: array<{_ENTRY}>, _bad: string>"
_ONE = f"struct<{_FIELDS}, _bad: string>"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Zone names of RFC 822; others count as UTC.
_ZONES = {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
_RFC = r"(?i)^\s*(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\.?\s+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(?:\(.*\)|([a-z]+|[+-]\d{4})\b.*)?$"
_ISO = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"


def instant(text: Column) -> Column:
    """An RFC 822 or ISO 8601 instant as a timestamp, else null; without a zone it is UTC."""
    part = lambda k: F.regexp_extract(text, _RFC, k)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part(2)))
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.when(part(3) < "69", "20").otherwise("19"), part(3)))
    zone = F.when(part(7).rlike(r"^[+-]"), F.concat(F.substring(part(7), 1, 3), F.lit(":"), F.substring(part(7), 4, 2)))
    for name, offset in _ZONES.items():
        zone = zone.when(F.upper(part(7)) == name, offset)
    pad = lambda c: F.lpad(c, 2, "0")
    second = F.when(part(6) == "", "00").otherwise(part(6))
    rfc = F.concat(year, F.lit("-"), pad(month.cast("string")), F.lit("-"), pad(part(1)), F.lit("T"), pad(part(4)), F.lit(":"), part(5), F.lit(":"), second, zone.otherwise("+00:00"))
    iso = F.regexp_replace(F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2"), r"([T ]\d{2}:\d{2})(?=\s*(Z|[+-]|$))", "$1:00")
    iso = F.when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$") & F.contains(iso, F.lit(":")), iso).when(F.length(iso) == 10, F.concat(iso, F.lit("T00:00:00Z"))).otherwise(F.concat(iso, F.lit("Z")))
    return F.when(text.rlike(_RFC) & (month > 0), F.try_to_timestamp(rfc)).when(text.rlike(_ISO), F.try_to_timestamp(F.replace(iso, F.lit(" "), F.lit("T"))))


def _said(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def _first(texts: Column, get=lambda x: x) -> Column:
    """The first text of a list that says something."""
    return F.get(F.filter(F.transform(texts, lambda x: _said(get(x))), lambda x: x.isNotNull()), 0)


def _of(e: Column) -> dict[str, Column]:
    text = lambda *names: F.coalesce(*[_first(e[n]) for n in names])
    value = lambda name: _first(e[name], lambda x: x["_VALUE"])
    linked = F.filter(e["link"], lambda x: x["_href"].isNotNull())
    meant = F.filter(linked, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    names = F.filter(F.transform(e["author"], lambda x: _said(x["name"])), lambda x: x.isNotNull())
    when = F.coalesce(*[instant(text(*group)) for group in (("pubDate", "published", "date"), ("updated",), ("created",))])
    utc = F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return {
        "title": text("title"), "link": F.coalesce(value("link"), F.get(meant, 0)["_href"], F.get(linked, 0)["_href"]), "guid": F.coalesce(value("guid"), value("id")),
        "author": F.coalesce(F.get(names, F.size(names) - 1), value("author"), text("creator")), "summary": text("summary", "description", "encoded", "content"), "published": utc,
    }


def entries(documents: DataFrame) -> DataFrame:
    """A row per entry in document order, and a row with ``error`` for each document without any (:data:`sparkwire.sources.feeds.ENTRIES`)."""
    latin = F.substring(F.col("content").cast("string"), 1, 200).rlike(r"(?i)encoding=[\"'](iso-8859-1|latin-?1|windows-1252)")
    text = F.when(latin, F.decode("content", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    text = F.regexp_replace(text, r"^\x{FEFF}?\s*(<\?xml[^>]*\?>)?", "")
    d = documents.select("feed", "ordinal", F.col("url").alias("feed_url"), "fetch_error", text.alias("_t"))
    refused = F.coalesce(F.col("_t").rlike("(?i)<!ENTITY"), F.lit(False))
    d = d.withColumn("_refused", refused).withColumn("_x", F.from_xml(F.when(~refused, F.col("_t")), _DOCUMENT, _OPTIONS))
    x = F.col("_x")
    whole = F.concat(*[F.coalesce(c, F.array().cast(f"array<{_ENTRY}>")) for c in (x["channel"]["item"], x["item"], x["entry"])])
    broken = F.col("_t").isNotNull() & ~refused & (x.isNull() | x["_bad"].isNotNull())
    pieces = F.regexp_extract_all(F.when(broken, F.col("_t")), F.lit(r"(?s)<(?:\w+:)?(item|entry)(?:\s[^>]*)?>.*?</(?:\w+:)?\1\s*>"), 0)
    read = F.transform(pieces, lambda p: F.from_xml(p, _ONE, _OPTIONS))
    fault = F.array_position(F.transform(read, lambda e: e.isNull() | e["_bad"].isNotNull()), F.lit(True))
    kept = F.transform(F.when(fault > 0, F.slice(read, F.lit(1), F.greatest(fault - 1, F.lit(0)).cast("int"))).otherwise(read), lambda e: F.struct(*[e[c].alias(c) for c in ("guid", "id", *_TEXTS, "link", "author")]))
    language = F.coalesce(F.get(F.filter(F.transform(x["channel"]["language"], _said), lambda t: t.isNotNull()), 0), _said(F.regexp_extract(F.when(broken, F.regexp_extract("_t", r"(?s)^.*?(?=<(?:item|entry)[\s>]|$)", 0)), r"(?s)<language>([^<]*)</language>", 1)))
    d = d.withColumns({"_found": F.when(broken, kept).when(F.col("_t").isNull() | refused, F.array().cast(f"array<{_ENTRY}>")).otherwise(whole), "language": language, "_broken": broken})
    error = F.when(F.col("_t").isNull(), F.col("fetch_error")).when(F.col("_refused"), "feed declares XML entities; refused for safety").when(F.col("_broken"), "malformed feed (ParseError)")
    head = ["feed", "ordinal", "feed_url"]
    each = d.select(*head, "language", F.posexplode("_found").alias("entry", "_e"))
    fields = _of(F.col("_e"))
    order = ("title", "link", "guid", "author", "summary", "published")
    told = each.select(*head, "entry", *[fields[c].alias(c) for c in order], "language", F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    silent = d.where(F.size("_found") == 0).select(*head, F.lit(None).cast("int").alias("entry"), *[none.alias(c) for c in order], none.alias("language"), error.alias("error"))
    return told.unionByName(silent)
