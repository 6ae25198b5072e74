"""The article state machine as a fold of maps: which events are accepted, which are refused, and what state each leaves.

A change of state is a compare-and-set: it holds only if the article is in a state from which the change is allowed, and in the state that
its writer saw, where the event names one. A refused event leaves the state as it was. So each event is a map of the 18
states (none, the eleven, FAILED by stage) to themselves, and a run of events is the composition of their maps, which is
associative: a long history is cut anywhere, each part composed by its own task, and the parts joined in order.

Rows are dealt out by ranges of (article, order). Only an article that crosses a border of partitions needs the composed map of its part
in each of them, at most two rows a partition; one grouped pass over those tells in which state a partition begins.
An article that holds most of the log is thus worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire import vocab
from sparkwire.operators.scan import pinned

#: (status, stage) by number; 0 is an article that is not registered yet.
STATES: tuple[tuple[str | None, str | None], ...] = ((None, None), *((s, None) for s in vocab.STATUSES), *(("FAILED", g) for g in vocab.STAGES))
_N, _TO, _STAGE, _FROM = len(STATES), len(vocab.STATUSES), len(vocab.STAGES) + 1, len(vocab.STATUSES) + 2
_REFUSED = _TO * _STAGE * _FROM  # the code of an event that can't be accepted anywhere


def allowed(status: str | None, stage: str | None, to: str) -> bool:
    if status is None:
        return to == "DISCOVERED"
    return any(a == status and b == to and (g is None or g == stage) for a, b, g in vocab.TRANSITIONS)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, accepted) by event code and state, and the state after recovery by state."""
    after = np.tile(np.arange(_N, dtype=np.uint8), (_REFUSED + 1, 1))
    accepted = np.zeros((_REFUSED + 1, _N), bool)
    number = {s: i for i, s in enumerate(STATES)}
    for t, to in enumerate(vocab.STATUSES):
        for g in range(_STAGE):
            stage = vocab.STAGES[g - 1] if g and to == "FAILED" else None
            for f in range(_FROM - 1):  # 0: no state named; the last: a name that is no state, which never holds
                for i, (status, held) in enumerate(STATES):
                    if allowed(status, held, to) and (f == 0 or vocab.STATUSES[f - 1] == status):
                        code = (t * _STAGE + g) * _FROM + f
                        after[code, i], accepted[code, i] = number[to, stage], True
    recovery = np.arange(_N, dtype=np.uint8)
    recovery[number["ANALYZING", None]] = number["DISCOVERED", None]
    recovery[number["PUBLISHING", None]] = number["FAILED", "publish_unknown"]
    return after, accepted, recovery


def event_code(to: Column, stage: Column, expected: Column) -> Column:
    """The number of an event's map."""
    place = lambda c, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)).cast("int")
    t, g = place(to, vocab.STATUSES), place(stage, vocab.STAGES)
    f = F.when(expected.isNull(), 0).otherwise(F.when(place(expected, vocab.STATUSES) > 0, place(expected, vocab.STATUSES)).otherwise(_FROM - 1))
    return F.when(t == 0, _REFUSED).otherwise(((t - 1) * _STAGE + g) * _FROM + f).cast("int")


def _segments(lease: int | None) -> Callable:
    """Of a sorted partition: the composed map of its first article, and the state in which its last one ends."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, _, recovery = tables()
        first, inner, part = None, False, None
        f_map, f_from, f_to = np.arange(_N, dtype=np.uint8), None, None
        article, state, at_from, at_to = None, 0, None, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("_article", "_code", "_at", "_part"))
            for a, code, at, part in zip(*columns, strict=True):  # noqa: B007
                if first is None:
                    first, f_from, f_to = (a,), at, at
                if not inner and a == first[0]:
                    if lease is not None and at - f_to > lease:
                        f_map = recovery[f_map]
                    f_map, f_to = after[code][f_map], at
                    continue
                if not inner or a != article:
                    inner, article, state, at_from, at_to = True, a, 0, at, at
                if lease is not None and at - at_to > lease:
                    state = recovery[state]
                state, at_to = after[code, state], at
        rows = [] if first is None else [(part, first[0], f_map.tolist(), f_from, f_to)]
        if inner:
            rows.append((part, article, [int(state)] * _N, at_from, at_to))
        kinds = [pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["p", "a", "map", "first_at", "last_at"])

    return walk


def _carried(lease: int | None) -> Callable:
    def states(rows: pd.DataFrame) -> pd.DataFrame:
        _, _, recovery = tables()
        rows, state, last, out = rows.sort_values("p"), 0, None, []
        for r in rows.itertuples():
            before = state
            if lease is not None and last is not None and r.first_at - last > lease:
                state = int(recovery[state])
            out.append((r.p, r.a, state, state != before))
            state, last = r.map[state], r.last_at
        return pd.DataFrame(out, columns=["_p", "_a", "_start", "_back"])

    return states


def _replayed(columns: list[str], lease: int | None) -> Callable:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, accepted, recovery = tables()
        article, state, last, begun = None, 0, None, False
        names, stages = pa.array([s for s, _ in STATES], pa.string()), pa.array([g for _, g in STATES], pa.string())
        for batch in batches:
            n = batch.num_rows
            before, now, held, back = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, bool)
            rows = zip(*(batch.column(c).to_pylist() for c in ("_article", "_code", "_at", "_start", "_back")), strict=True)
            for i, (a, code, at, start, recovered) in enumerate(rows):
                if not begun or a != article:
                    begun, article, state, last = True, a, start or 0, at
                    back[i] = bool(recovered)
                if lease is not None and at - last > lease and recovery[state] != state:
                    state, back[i] = recovery[state], True
                before[i], held[i] = state, accepted[code, state]
                state, last = after[code, state], at
                now[i] = state
            arrays = [batch.column(c) for c in columns]
            arrays += [names.take(pa.array(before)), stages.take(pa.array(before)), pa.array(back), pa.array(held), names.take(pa.array(now)), stages.take(pa.array(now))]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "before", "stage_before", "recovered", "accepted", "after", "stage_after"])

    return walk


def replay(
    events: DataFrame, article: str = "article_id", order: tuple[str, ...] = ("event_id",), expected: str | None = "from_status", at: str = "created_at", lease_minutes: int | None = None,
    pin: Callable[[DataFrame], DataFrame] = pinned,
) -> DataFrame:
    """Every event with the state it met (``before``, ``stage_before``), whether it was ``accepted``, and the state it left (``after``, ``stage_after``).

    ``expected`` names the column with the state that the writer saw; null or no such column: any. With ``lease_minutes``, an article that is left
    in ANALYZING or PUBLISHING without any event for longer is recovered before its next event, which is then ``recovered``. ``order`` has to be unique in an article.
    Events of no article (null) are one history of their own. Columns of ``events`` with the names of the result's are replaced.
    """
    events = events.drop("before", "stage_before", "recovered", "accepted", "after", "stage_after")
    stage = F.col("stage") if "stage" in events.columns else F.lit(None).cast("string")
    seen = F.col(expected) if expected and expected in events.columns else F.lit(None).cast("string")
    time = F.unix_micros(F.col(at).cast("timestamp")) if lease_minutes is not None else F.lit(0).cast("long")
    lease = None if lease_minutes is None else lease_minutes * 60_000_000
    rows = events.withColumns({"_article": F.col(article).cast("string"), "_code": event_code(F.col("to_status"), stage, seen), "_at": time})
    keys = [F.col(article), *map(F.col, order)]
    # the sorted partitions are kept as they are: both passes read them in order, without a shuffle
    rows = pin(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    slim = rows.select("_article", "_code", "_at", "_part")
    segments = slim.mapInArrow(_segments(lease), "p int, a string, map array<int>, first_at long, last_at long")
    starts = segments.groupBy("a").applyInPandas(_carried(lease), "_p int, _a string, _start int, _back boolean").where("_start <> 0")
    # at most two rows a partition
    rows = rows.join(F.broadcast(starts), (F.col("_part") == F.col("_p")) & F.col("_article").eqNullSafe(F.col("_a")), "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return rows.mapInArrow(_replayed(events.columns, lease), f"{kinds}, before string, stage_before string, recovered boolean, accepted boolean, after string, stage_after string")
