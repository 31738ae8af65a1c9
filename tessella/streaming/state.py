"""State machines as ordered folds: circuit breaker, rate limit, sessions, checkpoints.

Each machine is a step function from (state, event) to (state, output). ``folded`` runs it over a table: rows are dealt by
key and sorted, then pass through in order, one state at a time in memory. ``folded_stream`` runs the same step on a
stream, with the state in Spark's state store.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "key string, seq long, output string"
Step = Callable[[Any, pd.Series], tuple[Any, str]]


def folded(events: DataFrame, step: Callable[[], Step]) -> DataFrame:
    """(key, seq, output) for every event of key, seq, ts (seconds), event and value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, turn = None, None, step()
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                if row.key != key:
                    key, state = row.key, None
                state, told = turn(state, row)
                out.append((row.key, row.seq, told))
            yield pd.DataFrame(out, columns=["key", "seq", "output"])

    slim = events.select("key", "seq", "ts", "event", "value")
    return slim.repartition(F.col("key")).sortWithinPartitions("key", "seq").mapInPandas(run, OUTPUT)


def folded_stream(events: DataFrame, step: Callable[[], Step]) -> DataFrame:
    """The same over a stream; events of a key are ordered by seq within each trigger."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, store):
        state, turn = (json.loads(store.get[0]) if store.exists else None), step()
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for row in rows.itertuples(index=False):
            state, told = turn(state, row)
            out.append((key[0], row.seq, told))
        store.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=["key", "seq", "output"])

    return events.select("key", "seq", "ts", "event", "value").groupBy("key").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(failures: int = 5, successes: int = 2, timeout_s: float = 30.0) -> Callable[[], Step]:
    """Closed opens at N failures; Open is tried again after the timeout; HalfOpen closes at M successes, opens at any failure."""

    def make() -> Step:
        def step(state, row):
            name, count, since = state or ["Closed", 0, 0.0]
            if name == "Open" and row.ts - since >= timeout_s:
                name, count = "HalfOpen", 0
            if name == "Open":
                return [name, count, since], "Open"
            if row.event == "failure":
                count = count + 1 if name == "Closed" else failures
                if count >= failures:
                    name, count, since = "Open", 0, row.ts
            elif name == "HalfOpen":
                count += 1
                if count >= successes:
                    name, count = "Closed", 0
            else:
                count = 0
            return [name, count, since], name

        return step

    return make


def rate_limit(most: int = 10, span_s: float = 1.0) -> Callable[[], Step]:
    """Accepts fewer than ``most`` attempts in the last second; rejected attempts do not count."""

    def make() -> Step:
        def step(state, row):
            accepted = deque(t for t in state or [] if row.ts - t < span_s)
            if len(accepted) >= most:
                return list(accepted), "rejected"
            accepted.append(row.ts)
            return list(accepted), "accepted"

        return step

    return make


# The order of a sync session, by the event that leads on.
SESSION_STEPS = {("Initializing", "hello"): "Negotiating", ("Negotiating", "summary"): "ComputingDiff", ("ComputingDiff", "manifest"): "Transferring", ("Transferring", "chunk"): "Transferring", ("Transferring", "last_chunk"): "Verifying", ("Verifying", "verified"): "Completed"}


def sync_session(steps: dict[tuple[str, str], str] | None = None) -> Callable[[], Step]:
    """A message in the wrong state fails the session; completed and failed sessions stay as they are."""
    known = steps or SESSION_STEPS

    def make() -> Step:
        def step(state, row):
            now = state or "Initializing"
            if now not in ("Completed", "Failed"):
                now = known.get((now, row.event), "Failed")
            return now, now

        return step

    return make


def checkpoint() -> Callable[[], Step]:
    """Applies updates to a checkpoint: stage, file done, chunk done, bytes, error, retry, finish."""

    def make() -> Step:
        def step(state, row):
            c = state or {"stage": 0, "files": 0, "chunks": 0, "bytes": 0.0, "errors": 0, "retries": 0, "done": False}
            change = {"stage": ("stage", row.value), "file": ("files", c["files"] + 1), "chunk": ("chunks", c["chunks"] + 1), "bytes": ("bytes", c["bytes"] + row.value), "error": ("errors", c["errors"] + 1), "retry": ("retries", c["retries"] + 1), "finish": ("done", True)}.get(row.event)
            if change:
                c = c | {change[0]: change[1]}
            return c, json.dumps(c, sort_keys=True)

        return step

    return make


def save_cadence(interval_s: float = 30.0) -> Callable[[], Step]:
    """Saves a transfer's checkpoint once the interval has passed since the last save; its first event starts the clock."""

    def make() -> Step:
        def step(state, row):
            since = row.ts if state is None else state
            return (row.ts, "saved") if row.ts - since >= interval_s else (since, "kept")

        return step

    return make


def retry_queue(events: DataFrame, most: int = 3) -> DataFrame:
    """Failed items to be pushed again: those with fewer than ``most`` failures since their last success."""
    last = events.where("event = 'success'").groupBy("key").agg(F.max("seq").alias("since"))
    failed = events.where("event = 'failure'").join(last, "key", "left").where(F.col("seq") > F.coalesce("since", F.lit(-1)))
    return failed.groupBy("key").agg(F.count("*").alias("failures")).where(F.col("failures") < most)
