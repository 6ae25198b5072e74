"""The feed scan as a Spark data source: one partition, and so one task, for each feed, in batch and as a stream.

A feed that fails gives a row with ``fetch_error`` and never stops the others. The transport is a function that is shipped to the tasks; it has to guard its own targets
(:func:`sparkwire.sources.feeds.is_public_target`). How many feeds are read at once is the number of the cluster's cores; the batch form can be held to fewer.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sparkwire.sources.feeds import DOCUMENTS, Feed, Fetcher


@dataclass
class FeedPartition(InputPartition):
    name: str
    ordinal: int
    url: str
    poll: int = 0


def _listed(options: dict) -> list[FeedPartition]:
    return [FeedPartition(name, i, url) for i, (name, url, enabled) in enumerate(json.loads(options["registry"])) if enabled]


def _document(fetch: Fetcher, feed: FeedPartition) -> tuple:
    body, error = fetch(feed.url)
    return feed.name, feed.ordinal, feed.url, None if body is None else bytearray(body), error


class FeedReader(DataSourceReader):
    def __init__(self, feeds: list[FeedPartition], fetch: Fetcher):
        self.feeds, self.fetch = feeds, fetch

    def partitions(self) -> list[InputPartition]:
        return self.feeds

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        if partition is not None:  # an empty registry has one partition without a feed
            yield _document(self.fetch, partition)


class FeedStreamReader(DataSourceStreamReader):
    """Polls every feed once in each interval of the clock. An offset is the interval's number, so a batch that is run again after a failure covers the same
    polls; what it fetches may be newer, and rows that were seen are dropped by key further down (:func:`sparkwire.streaming.dedup.append_new`).
    Polls that were missed are not made up for: a feed has no past."""

    def __init__(self, feeds: list[FeedPartition], fetch: Fetcher, every: int, now: Callable[[], float]):
        self.feeds, self.fetch, self.every, self.now = feeds, fetch, every, now

    def initialOffset(self) -> dict:  # noqa: N802 - the interface's names
        return {"poll": int(self.now() // self.every) - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"poll": int(self.now() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [FeedPartition(f.name, f.ordinal, f.url, end["poll"]) for f in self.feeds] if end["poll"] > start["poll"] else []

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        yield (*_document(self.fetch, partition), partition.poll)

    def commit(self, end: dict) -> None:
        pass


def feed_source(fetch: Fetcher, now: Callable[[], float] = time.time) -> type[DataSource]:
    """The data source ``feeds`` with a transport; options ``registry`` (JSON of [name, url, enabled]) and, as a stream, ``every`` (seconds, 1800)."""

    class Feeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return "feeds"

        def schema(self) -> str:
            return DOCUMENTS + (", poll long" if self.options.get("stream") == "true" else "")

        def reader(self, schema) -> DataSourceReader:
            return FeedReader(_listed(self.options), fetch)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return FeedStreamReader(_listed(self.options), fetch, int(self.options.get("every", "1800")), now)

    return Feeds


def _options(feeds: list[Feed]) -> str:
    return json.dumps([[f.name, f.url, f.enabled] for f in feeds])


def documents(spark: SparkSession, feeds: list[Feed], fetch: Fetcher) -> DataFrame:
    """The documents of the enabled feeds (feed, ordinal, url, content, fetch_error), fetched when the frame is read, a task for each feed."""
    spark.dataSource.register(feed_source(fetch))
    return spark.read.format("feeds").option("registry", _options(feeds)).load()


def document_stream(spark: SparkSession, feeds: list[Feed], fetch: Fetcher, every: int = 1800, now: Callable[[], float] = time.time) -> DataFrame:
    """The same as a stream with the ``poll``: every feed once in ``every`` seconds."""
    spark.dataSource.register(feed_source(fetch, now))
    return spark.readStream.format("feeds").option("registry", _options(feeds)).option("stream", "true").option("every", str(every)).load()
