"""The state machine and the seven-day twin as streams: arbitrary keyed state, restored from the checkpoint after a restart.

Both need the RocksDB state store (:func:`use_rocksdb`). They give what the batch operators give on the same rows, in whatever micro-batches
the rows come, as long as a key's rows come in order between batches; inside a batch they are put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkwire.operators import fold
from sparkwire.vocab import LEASE_MINUTES, SAME_STORY_DAYS

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HISTORY = "event_id long, article_id long, before string, stage_before string, recovered boolean, accepted boolean, after string, stage_after string, at timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers is kept by this provider alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class ArticleMachine(StatefulProcessor):
    """One article: the number of its state, the time of its last event, and whether a timer has recovered it since."""

    def __init__(self, lease_minutes: int):
        self.lease = lease_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state int, at long, recovered boolean")
        self.after, self.accepted, self.recovery = fold.tables()

    def _deadline(self, at: int) -> int:
        """The first millisecond after the lease."""
        return (at + self.lease) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803 - the interface's names
        batch = pd.concat(list(rows)).sort_values("event_id")
        state, at, recovered = self.held.get() if self.held.exists() else (0, None, False)
        if at is not None:
            self.handle.deleteTimer(self._deadline(at))
        out = []
        for event, code, time, when in zip(batch["event_id"], batch["code"], batch["micros"], batch["created_at"], strict=True):
            if at is not None and time - at > self.lease and self.recovery[state] != state:
                state, recovered = int(self.recovery[state]), True
            before, ok = state, bool(self.accepted[code, state])
            state, at = int(self.after[code, state]), int(time)
            out.append((event, key[0], *fold.STATES[before], recovered, ok, *fold.STATES[state], when))
            recovered = False
        self.held.update((state, at, False))
        if self.recovery[state] != state:
            self.handle.registerTimer(self._deadline(at))
        yield _rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        state, at, _ = self.held.get()
        now = int(self.recovery[state])
        if now == state or expiredTimerInfo.getExpiryTimeInMs() != self._deadline(at):
            return
        self.held.update((now, at, True))
        yield _rows([(None, key[0], *fold.STATES[state], True, True, *fold.STATES[now], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))])

    def close(self) -> None:
        pass


_COLUMNS = [c.split()[0] for c in _HISTORY.split(", ")]


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({"event_id": "Int64", "recovered": bool, "accepted": bool, "at": "datetime64[us]"})


def article_states(events: DataFrame, lease_minutes: int = LEASE_MINUTES, late: str = "0 seconds", expected: str = "from_status") -> DataFrame:
    """The stream form of :func:`sparkwire.operators.fold.replay`: a row for each event, and one without ``event_id`` when a timer recovers an article that
    was left in ANALYZING or PUBLISHING. Timers follow the watermark of ``created_at``. An event that comes after its article was recovered by a timer
    is told so (``recovered``), as in the batch form. Events of no article are left out: a stream has no key for them."""
    from pyspark.sql import functions as F

    code = fold.event_code(F.col("to_status"), F.col("stage"), F.col(expected))
    rows = events.where("article_id is not null").withWatermark("created_at", late)
    rows = rows.select("event_id", "article_id", "created_at", code.alias("code"), F.unix_micros("created_at").alias("micros"))
    return rows.groupBy("article_id").transformWithStateInPandas(ArticleMachine(lease_minutes), _HISTORY, "append", "eventTime")


class HeadlineTwins(StatefulProcessor):
    """One fingerprint: the ids of the last days that can still be a later row's twin, the least of them last.

    An id is dropped when a smaller one comes, as that one lives longer, so ids rise with time in what is kept.
    """

    def __init__(self, days: int):
        self.span = days * 86400

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "id long, at long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        batch = pd.concat(list(rows)).sort_values(["seconds", "id"])
        held = [(int(i), int(t)) for i, t in self.seen.get()]
        twins = []
        for i, t in zip(batch["id"].astype(int), batch["seconds"].astype(int), strict=True):
            held = [x for x in held if x[1] >= t - self.span]
            least = min((x[0] for x in held), default=None)
            twins.append(least if least is not None and least < i else None)
            held = [x for x in held if x[0] < i] + [(i, t)]
        self.seen.put(held)
        expiry = (max(t for _, t in held) + self.span + 1) * 1000
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(expiry)
        self.timer.update((expiry,))
        yield pd.DataFrame({"id": batch["id"], "title_fingerprint": key[0], "discovered_at": batch["discovered_at"], "twin_of": pd.array(twins, "Int64"), "status": ["DISCOVERED" if t is None else "REJECTED" for t in twins]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        """Nothing can be a twin of what is held any more."""
        self.seen.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def headline_twins(stream: DataFrame, days: int = SAME_STORY_DAYS, late: str = "0 seconds") -> DataFrame:
    """The stream form of :func:`sparkwire.operators.dedup.same_story`: every row, with the least earlier id of its headline within ``days`` and the status REJECTED
    where there is one. Refused twins count for later rows, as in the batch form. Rows are (id, title_fingerprint, discovered_at); those without a fingerprint have no twin
    and are not kept in state: union them back from the input. What a headline holds is dropped ``days`` after its last row."""
    from pyspark.sql import functions as F

    rows = stream.where("title_fingerprint is not null").withWatermark("discovered_at", late)
    rows = rows.select("id", "title_fingerprint", "discovered_at", F.unix_seconds("discovered_at").alias("seconds"))
    out = "id long, title_fingerprint string, discovered_at timestamp, twin_of long, status string"
    return rows.groupBy("title_fingerprint").transformWithStateInPandas(HeadlineTwins(days), out, "append", "eventTime")
