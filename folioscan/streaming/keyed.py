"""Keyed processors: rate admission, credits, answer reuse, document completion.

Rows of one key and one batch are put in order first; the decisions are the same
step functions that the batch forms fold over.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.usage import CACHE_TTL_MS, CAPACITY, START_CREDITS, WINDOW_MS, admit_step, reuse_step
from .runner import use_rocksdb


def _ordered(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


class Admission(StatefulProcessor):
    """Holds the admitted (time, cost) pairs of the window of one bucket."""

    def __init__(self, capacity: int, window_ms: int):
        self.step = admit_step(capacity, window_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "ms long, cost long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = deque((int(ms), int(cost)) for ms, cost in self.held.get())
        state = (held, sum(c for _, c in held))
        part = _ordered(rows, ["ms", "event_id"])
        outcome = []
        for row in part.itertuples(index=False):
            state, ok = self.step(state, row)
            outcome.append(ok)
        if state[0]:
            self.held.put([(int(ms), int(cost)) for ms, cost in state[0]])
        else:
            self.held.clear()
        yield pd.DataFrame({"bucket": key[0], "event_id": part["event_id"], "admitted": outcome})

    def close(self) -> None:
        pass


def admitted(requests: DataFrame, capacity: int = CAPACITY, window_ms: int = WINDOW_MS) -> DataFrame:
    use_rocksdb(requests.sparkSession)
    return requests.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Admission(capacity, window_ms),
        outputStructType="bucket string, event_id long, admitted boolean", outputMode="Append", timeMode="None",
    )


class Credits(StatefulProcessor):
    """Holds the balance of one user."""

    def __init__(self, start: int):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "balance long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        balance = int(self.balance.get()[0]) if self.balance.exists() else self.start
        part = _ordered(rows, ["ms", "event_id"])
        balances, granted = [], []
        for op in part["op"]:
            granted.append(balance > 0 if op == "consume" else None)
            balance = balance + 1 if op != "consume" else max(balance - 1, 0)
            balances.append(balance)
        self.balance.update((balance,))
        yield pd.DataFrame({
            "user_id": key[0], "event_id": part["event_id"].to_numpy(), "balance": balances,
            "granted": pd.Series(granted, dtype=object),
        })

    def close(self) -> None:
        pass


def credit_ledger(log: DataFrame, start: int = START_CREDITS) -> DataFrame:
    use_rocksdb(log.sparkSession)
    return log.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Credits(start),
        outputStructType="user_id long, event_id long, balance long, granted boolean",
        outputMode="Append", timeMode="None",
    )


class Reuse(StatefulProcessor):
    """Holds the time of the answer now kept for one cache key; a timer forgets it when it expires."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms
        self.step = reuse_step(ttl_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = int(self.since.get()[0]) if self.since.exists() else None
        before = state
        part = _ordered(rows, ["ms", "event_id"])
        hits = []
        for row in part.itertuples(index=False):
            state, hit = self.step(state, row)
            hits.append(hit)
        if state != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            self.since.update((state,))
            self.handle.registerTimer(state + self.ttl_ms)
        yield pd.DataFrame({"cache_key": key[0], "event_id": part["event_id"], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.since.clear()
        return iter([])

    def close(self) -> None:
        pass


def answer_reuse(questions: DataFrame, ttl_ms: int = CACHE_TTL_MS, late: str = "1 hour") -> DataFrame:
    """``questions``: cache_key, event_id, ms, ts. Rows later than ``late`` are not expected."""
    use_rocksdb(questions.sparkSession)
    timed = questions.withWatermark("ts", late)
    return timed.groupBy("cache_key").transformWithStateInPandas(
        statefulProcessor=Reuse(ttl_ms), outputStructType="cache_key string, event_id long, hit boolean",
        outputMode="Append", timeMode="EventTime",
    )


class Completion(StatefulProcessor):
    """Counts expected and embedded passages of one document, in whatever order they arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "expected long, embedded long, partial boolean, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expected, embedded, partial, done = self.counts.get() if self.counts.exists() else (-1, 0, False, False)
        for part in rows:
            told = part[part["kind"] == "expected"]
            if len(told):
                expected = int(told["n"].max())
                partial = bool(partial or told["partial"].any())
            embedded += int(part.loc[part["kind"] == "embedded", "n"].sum())
        ready = not done and 0 <= expected <= embedded
        self.counts.update((int(expected), int(embedded), bool(partial), bool(done or ready)))
        if ready:
            yield pd.DataFrame({
                "document_id": [key[0]], "status": ["partial" if partial else "ready"], "chunk_count": [embedded],
            })

    def close(self) -> None:
        pass


def completed(progress: DataFrame) -> DataFrame:
    """Documents whose passages are all embedded, each reported once.

    ``progress``: document_id, kind (expected or embedded), n, partial. A document
    with a failed page window stays partial.
    """
    use_rocksdb(progress.sparkSession)
    return progress.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=Completion(), outputStructType="document_id long, status string, chunk_count long",
        outputMode="Append", timeMode="None",
    )


