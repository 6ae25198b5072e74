"""Feed registry, and feed documents to articles.

Documents are rows (feed, ordinal, content); ``from_files`` reads them through Spark, so any store that Spark
reads will do. Parsing is a Python data step over Arrow batches, one feed a row: a broken
document becomes an error row and never stops the others.
"""

from __future__ import annotations

import ipaddress
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.functions import text as X
from sparkwire.functions import urls as N
from sparkwire.operators.dedup import first_wins

MAX_FEED_BYTES, MAX_SECONDS, ATTEMPTS, PARALLEL, MAX_WAIT = 10 * 1024 * 1024, 60, 3, 8, 30.0
TOO_LARGE = "feed is larger than 10 MB"
TRANSIENT_STATUS = (429, 500, 502, 503, 504)
REGISTRY = "name string, url string, enabled boolean, ordinal int"
DOCUMENTS = "feed string, ordinal int, url string, content binary, fetch_error string"
ENTRIES = (
    "feed string, ordinal int, feed_url string, entry int, title string, link string, guid string, author string, "
    "summary string, published string, language string, error string"
)


class RegistryError(ValueError):
    pass


@dataclass(frozen=True)
class Feed:
    name: str
    url: str
    enabled: bool = True


def registry(text: str) -> list[Feed]:
    """Feeds of a YAML registry; any fault is an error."""
    import yaml

    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RegistryError(f"not valid YAML: {e}") from e
    entries = data.get("feeds") if isinstance(data, dict) else None
    if not isinstance(entries, list) or not entries:
        raise RegistryError("a list 'feeds' with one feed at least is needed")
    out: dict[str, Feed] = {}
    for i, e in enumerate(entries, 1):
        if not isinstance(e, dict):
            raise RegistryError(f"feed {i} is no mapping")
        name, url, enabled = str(e.get("name") or "").strip(), str(e.get("url") or "").strip(), e.get("enabled", True)
        if not name or not url:
            raise RegistryError(f"feed {i} needs a name and a url")
        if not re.match(r"(?i)https?://[^/?#\s]", url) or re.search(r"[\s<>\"{}|\\^`]", url):
            raise RegistryError(f"feed {name!r}: the url is no http(s) url")
        if not isinstance(enabled, bool):
            raise RegistryError(f"feed {name!r}: enabled has to be true or false")
        if name.lower() in out:
            raise RegistryError(f"feed {name!r} is there twice")
        out[name.lower()] = Feed(name, url, enabled)
    return list(out.values())


def selected(feeds: list[Feed], names: Iterable[str]) -> list[Feed]:
    """Feeds by name in any case, enabled by being asked for."""
    by = {f.name.lower(): f for f in feeds}
    wanted = {n.strip().lower() for n in names}
    if missing := sorted(wanted - by.keys()):
        raise RegistryError(f"unknown feeds: {', '.join(missing)}")
    return [Feed(f.name, f.url, True) for f in feeds if f.name.lower() in wanted]


def registry_frame(spark: SparkSession, feeds: list[Feed]) -> DataFrame:
    return spark.createDataFrame([(f.name, f.url, f.enabled, i) for i, f in enumerate(feeds)], REGISTRY)


def is_public_target(url: str, resolve: Callable[[str], list[str]]) -> bool:
    """Whether a fetch may go to the url: http(s), no local name, no number for a host, all its addresses public."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".").lower()
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith(".localhost"):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        pass
    if re.fullmatch(r"(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+))*", host):
        return False
    addresses = resolve(host)
    return bool(addresses) and all(ipaddress.ip_address(a).is_global for a in addresses)


def may_redirect(origin: str, to: str, hops: int) -> bool:
    """At most five, and never from https to http."""
    return hops <= 5 and not (origin.startswith("https:") and to.startswith("http:"))


@dataclass(frozen=True)
class Fetcher:
    """A bounded fetch of one feed by a given transport ``get(url) -> (status, headers, body)``. Transient failures are tried ATTEMPTS times, after 1, 2, 4 ...
    seconds, MAX_WAIT at most; what took more than MAX_SECONDS, or is too large, is refused."""

    get: Callable[[str], tuple[int, dict, bytes]]
    wait: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic

    def __call__(self, url: str) -> tuple[bytes | None, str | None]:
        """(body, None) or (None, what went wrong)."""
        for attempt in range(1, ATTEMPTS + 1):
            if attempt > 1:
                self.wait(min(MAX_WAIT, 2.0 ** (attempt - 2)))
            began = self.clock()
            try:
                status, headers, body = self.get(url)
            except TimeoutError:
                error = "timed out"
            except OSError as e:
                error = f"network error: {type(e).__name__}"
            except ValueError:
                return None, "invalid URL"
            else:
                if status in TRANSIENT_STATUS and attempt < ATTEMPTS:
                    continue
                if status != 200:
                    return None, f"HTTP {status} from feed server"
                if headers.get("content-encoding", "").strip().lower() not in ("", "identity"):
                    return None, "server sent a compressed feed"
                if len(body) > MAX_FEED_BYTES:
                    return None, TOO_LARGE
                if self.clock() - began > MAX_SECONDS:
                    return None, f"feed took more than {MAX_SECONDS} seconds"
                return body, None
        return None, error


def fetched(feeds: DataFrame, get: Callable[[str], tuple[int, dict, bytes]], wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """Documents of the enabled feeds of a table, up to PARALLEL at once; failures become rows with an error. A registry of the driver is
    better read by :func:`sparkwire.sources.scan.documents`, with a task for each feed."""
    one = Fetcher(get, wait, clock)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(u) for u in f["url"]]
            yield pd.DataFrame({"feed": f["name"], "ordinal": f["ordinal"], "url": f["url"], "content": [g[0] for g in got], "fetch_error": [g[1] for g in got]})

    return feeds.where("enabled").select("name", "ordinal", "url").repartition(PARALLEL, "name").mapInPandas(run, DOCUMENTS)


def from_files(spark: SparkSession, path: str, feeds: DataFrame) -> DataFrame:
    """Documents from files. A feed's file is called as the feed is, in small letters with hyphens for what is neither letter
    nor digit, or, if no other feed's url ends so, like the last part of its url."""
    files = spark.read.format("binaryFile").load(path)
    large = F.col("length") > MAX_FEED_BYTES
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.when(~large, F.col("content")).alias("content"), large.alias("large"))
    slug = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "-"), F.lit("-"))
    ending = F.element_at(F.split("url", "/"), -1)
    mine = feeds.where("enabled").withColumns({"slug": slug(F.col("name")), "ending": ending})
    only = mine.groupBy("ending").agg(F.count("*").alias("n")).where("n = 1").select(F.col("ending").alias("only"))
    mine = mine.join(only, F.col("ending") == F.col("only"), "left")
    by_name = files.select("path", slug(F.regexp_replace("file", r"\.[^.]*$", "")).alias("stem"), F.col("content").alias("n_content"), F.col("large").alias("n_large"))
    by_name = by_name.groupBy("stem").agg(F.min_by("n_content", "path").alias("n_content"), F.min_by("n_large", "path").alias("n_large"))  # of two files with one stem the least path
    out = mine.join(by_name, F.col("slug") == F.col("stem"), "left").join(files, F.col("only") == F.col("file"), "left")
    named = F.col("stem").isNotNull()
    content, large = F.when(named, F.col("n_content")).otherwise(F.col("content")), F.coalesce(F.when(named, F.col("n_large")).otherwise(F.col("large")), F.lit(False))
    error = F.when(large, TOO_LARGE).when(content.isNull(), "HTTP 404 from feed server")
    return out.select(F.col("name").alias("feed"), "ordinal", "url", content.alias("content"), error.alias("fetch_error"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _texts(node: ElementTree.Element, *names: str) -> str | None:
    for name in names:
        for child in node:
            if _local(child.tag) == name:
                text = "".join(child.itertext()).strip()
                if text:
                    return text
    return None


def parsed(content: bytes) -> tuple[list[dict], str | None]:
    """(entries, error) of an RSS or Atom document; entries read before a fault count."""
    if re.search(rb"<!ENTITY", content, re.I):
        return [], "feed declares XML entities; refused for safety"
    parser, fault = ElementTree.XMLPullParser(("start", "end")), None
    out, language, depth = [], None, []
    try:
        parser.feed(content)
        parser.close()
    except ElementTree.ParseError as e:
        fault = e
    try:
        for kind, node in parser.read_events():
            name = _local(node.tag)
            if kind == "start":
                depth.append(name)
                continue
            depth.pop()
            if name == "language" and "item" not in depth:
                language = (node.text or "").strip() or None
            if name in ("item", "entry"):
                link = _texts(node, "link")
                if not link:
                    links = [c for c in node if _local(c.tag) == "link" and c.get("href")]
                    best = [c for c in links if c.get("rel", "alternate") == "alternate"] or links
                    link = best[0].get("href") if best else None
                author = _texts(node, "author", "creator")
                for c in node:
                    if _local(c.tag) == "author" and len(c):
                        author = _texts(c, "name") or author
                out.append({
                    "title": _texts(node, "title"), "link": link, "guid": _texts(node, "guid", "id"), "author": author,
                    "summary": _texts(node, "summary", "description", "encoded", "content"),
                    "published": next((t for k in (("pubdate", "published", "date"), ("updated",), ("created",)) if (t := _iso(_texts(node, *k)))), None),
                })
    except ElementTree.ParseError as e:
        fault = e
    for e in out:
        e["language"] = language
    if fault is not None and not out:
        return [], f"malformed feed ({type(fault).__name__})"
    if not out and fault is None and not depth and b"<" not in content:
        return [], "malformed feed (no XML)"
    return out, None


def _iso(text: str | None) -> str | None:
    """An RFC 822 or ISO 8601 instant as ISO text in UTC, else None."""
    for read in (parsedate_to_datetime, datetime.fromisoformat):
        try:
            t = read(text)
        except (TypeError, ValueError, IndexError, AttributeError):
            continue
        t = t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
        return t.strftime("%Y-%m-%d %H:%M:%S")
    return None


def entries(documents: DataFrame) -> DataFrame:
    """A row per entry in document order, and a row with ``error`` for each document without any."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        for f in frames:
            rows = []
            for d in f.itertuples(index=False):
                head = {"feed": d.feed, "ordinal": d.ordinal, "feed_url": d.url}
                got, error = ([], d.fetch_error) if d.content is None else parsed(bytes(d.content))
                rows += [head | e | {"entry": i} for i, e in enumerate(got)]
                if error or not got:
                    rows.append(head | {"error": error})
            yield pd.DataFrame(rows, columns=names).astype({"entry": "Int32"}).astype(object).where(lambda x: x.notna(), None) if rows else pd.DataFrame(columns=names)

    return documents.mapInPandas(run, ENTRIES)


def articles(rows: DataFrame, now: str) -> DataFrame:
    """Usable entries as articles, the first of each url per feed, with ``rank`` newest first in the feed."""
    from pyspark.sql import Window

    at = F.to_timestamp(F.lit(now))
    link = N.strip(F.coalesce("link", F.lit("")))
    a = rows.where("error is null and entry is not null").withColumn("title", X.clean_title("title"))
    a = a.withColumn("link", link).where((F.col("title") != "") & (F.length("link") <= vocab.MAX_URL_CHARS))
    a = a.withColumn("canonical_url", N.canonical_url(F.col("link"))).where("canonical_url is not null")
    published = F.least(F.to_timestamp("published"), at)
    author = F.nullif(X.clean_title(F.col("author")), F.lit(""))
    a = a.select(
        "feed", "ordinal", "entry", "title", X.clean_summary(F.coalesce("summary", F.lit(""))).alias("summary"), F.col("link").alias("original_url"),
        "canonical_url", N.url_hash(F.col("canonical_url")).alias("url_hash"), F.col("feed").alias("source_name"), "feed_url",
        F.when(F.col("published").isNotNull(), published).alias("published_at"), at.alias("discovered_at"),
        F.when(F.col("author").isNotNull(), author).alias("author"),
        F.substring("guid", 1, vocab.GUID_CHARS).alias("guid"), "language", X.title_fingerprint(F.col("title")).alias("title_fingerprint"),
    )
    a = a.withColumn("feed_key", F.concat_ws("|", "ordinal", "url_hash"))
    a = first_wins(a, "feed_key", "ordinal", "entry").drop("feed_key")
    w = Window.partitionBy("ordinal").orderBy(F.col("published_at").desc_nulls_last(), "entry")
    return a.withColumn("rank", F.row_number().over(w).cast("long"))


def across_feeds(a: DataFrame) -> DataFrame:
    """The first of each url in feed order, newest first within a feed."""
    return first_wins(a, "url_hash", "ordinal", "rank")
