"""Answer providers: an interface, a choice by name, and answers of a whole table of prompts, with bounded retries and one correction.

A provider is made once in each task and asked row by row there; it is the outside world, so nothing here speeds it up. What it gives is a table that
:func:`sparkwire.plans.curate.run` takes. No provider that needs a network is part of this package.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire.operators import prompts, rules

ATTEMPTS, FIRST_WAIT, MOST_WAIT = 3, 2.0, 120.0


class ProviderError(Exception):
    """A request that failed; ``transient`` ones may be tried again. Some mean that the provider is out for everybody."""

    def __init__(self, message: str, transient: bool = False, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.transient, self.status, self.retry_after = transient, status, retry_after

    @property
    def is_outage(self) -> bool:
        return self.transient or self.status in (401, 403, 404)


class Provider(Protocol):
    def answer(self, prompt: str, schema: dict) -> str:
        """The text of the answer, or a :class:`ProviderError`."""


@dataclass(frozen=True)
class Recorded:
    """Answers that were recorded, by the article's url; it needs no key and no network."""

    answers: Mapping[str, str]
    default: str = ""

    def answer(self, prompt: str, schema: dict) -> str:
        import json

        data = prompt[prompt.index(prompts.START) + len(prompts.START) : prompt.index(prompts.END)]
        return self.answers.get(json.loads(data)["original_url"], self.default)


class UnknownProvider(ValueError):
    pass


def chosen(name: str, makers: Mapping[str, Callable[[str], Provider]], key: str = "") -> Callable[[], Provider]:
    """What makes the provider that the settings name, from the makers there are; a maker gets the key, and all but ``recorded`` need one."""
    if name not in makers:
        raise UnknownProvider(f"no provider {name!r}; there are: {', '.join(sorted(makers))}")
    if name != "recorded" and not key:
        raise UnknownProvider(f"provider {name!r} needs a key")
    maker = makers[name]
    return lambda: maker(key)


def asked(provider: Provider, prompt: str, schema: dict, wait: Callable[[float], None] = time.sleep) -> str:
    """One answer; transient failures are tried ATTEMPTS times, after a doubling wait or the one that the provider asks for."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return provider.answer(prompt, schema)
        except ProviderError as e:
            if not e.transient or attempt == ATTEMPTS:
                raise
            wait(min(MOST_WAIT, max(FIRST_WAIT * 2 ** (attempt - 1), e.retry_after or 0.0)))
    raise AssertionError("not reached")


def answers(rows: DataFrame, prompt: Column, make: Callable[[], Provider], wait: Callable[[float], None] = time.sleep, key: str = "original_url") -> DataFrame:
    """(key, answer, error) of each row's prompt. ``error`` is ``outage`` where the provider is out, and after that for the rest of the task, which is not asked."""
    schema = prompts.answer_schema()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider, out = make(), False
        for b in batches:
            told: list[tuple[str | None, str | None]] = []
            for text in b.column(1).to_pylist():
                if out:
                    told.append((None, "outage"))
                    continue
                try:
                    told.append((asked(provider, text, schema, wait), None))
                except ProviderError as e:
                    out = e.is_outage
                    told.append((None, "outage" if out else f"{type(e).__name__}: {e}"))
                except Exception as e:  # noqa: BLE001 - a fault in a provider is charged to the row
                    told.append((None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.string())], [key, "answer", "error"])

    return rows.select(key, prompt.alias("prompt")).mapInArrow(ask, f"{key} string, answer string, error string")


def with_corrections(rows: DataFrame, make: Callable[[], Provider], pin: Callable[[DataFrame], DataFrame], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(original_url, answer, error, correction) of articles: each is asked once, and those whose answer breaks a rule once more, with the rule. A provider
    is asked no row twice for one round, so both rounds are kept as they come."""
    data = prompts.record(F.col("title"), F.col("summary"), F.col("original_url"), F.col("published_at"), F.col("source_name"))
    first = pin(answers(rows, prompts.prompt(data), make, wait))
    facts = rows.select("original_url", "title", "summary", "source_name", "published_at")
    wrong = rules.verdict(first.where("answer is not null").join(facts, "original_url")).where("outcome = 'invalid'").select(*facts.columns, "rule")
    again = pin(answers(wrong, prompts.prompt(data, F.col("rule")), make, wait))
    return first.join(again.select("original_url", F.col("answer").alias("correction")), "original_url", "left")
