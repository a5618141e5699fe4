"""Folds over a key's rows in time order: admission, token buckets, concurrency, circuit breakers.

Rows are dealt by key, sorted by key and order inside their partition and streamed: a fold holds its state
and one Arrow batch, never a key's rows. What a row gives depends on all rows of its key before it, so a
key is one task's work; its state is bounded by the limit that it enforces.
"""

import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A fold: a fresh state for a key; a function of state and row (named tuple of the needed columns) that gives the new columns.
Step = Callable[[dict, tuple], tuple]


def fold(rows: DataFrame, key: str, order: list[str], needs: list[str], columns: str, step: Step) -> DataFrame:
    """rows with new columns (a DDL list) from `step`, called with a key's state (a dict, empty at first) and the needed values. Rows
    without a key are one key's; a null among the needed numbers is NaN."""
    added = T.StructType.fromDDL(columns)
    kinds = [to_arrow_type(f.dataType) for f in added]
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)

    def values(column: pa.Array) -> list:
        found = column.to_pylist()
        return [float("nan") if v is None else v for v in found] if pa.types.is_floating(column.type) else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), {}
        for batch in batches:
            out = []
            for value, *needed in zip(batch.column(key).to_pylist(), *(values(batch.column(n)) for n in needs), strict=True):
                own = "NaN" if value != value else value  # NaN isn't equal to itself
                if own != now:
                    now, state = own, {}
                out.append(step(state, tuple(needed)))
            new = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.names])

    return sorted_rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def sliding_log(limit: int, window: float) -> Step:
    """admitted, remaining, retry_after of a request at a time in seconds: `limit` admitted ones in any `window` seconds; refused
    ones don't count."""

    def step(state: dict, row: tuple) -> tuple:
        (at,) = row
        log: deque = state.setdefault("log", deque())
        while log and log[0] <= at - window:
            log.popleft()
        if len(log) < limit:
            log.append(at)
            return True, limit - len(log), 0
        return False, 0, math.ceil(log[0] + window - at)

    return step


def token_bucket(rate: float, capacity: int) -> Step:
    """admitted, tokens: a request takes a token; `rate` tokens a second flow back, up to capacity."""

    def step(state: dict, row: tuple) -> tuple:
        (at,) = row
        tokens = min(capacity, state.get("tokens", capacity) + (at - state.get("at", at)) * rate)
        admitted = tokens >= 1
        state["tokens"], state["at"] = tokens - admitted, at
        return admitted, round(state["tokens"], 6)

    return step


def concurrency(limit: int, ttl: float) -> Step:
    """admitted, running: an admitted request holds one of `limit` places for its duration, `ttl` seconds at most."""

    def step(state: dict, row: tuple) -> tuple:
        at, duration = row
        state["ends"] = ends = [e for e in state.get("ends", []) if e > at]
        admitted = len(ends) < limit
        if admitted:
            ends.append(at + min(duration, ttl))
        return admitted, len(ends)

    return step


def circuit_breaker(failures: int = 5, window: int = 10, recovery: float = 30.0, probes: int = 3) -> Step:
    """called, state (closed, open, half_open; after the row) of a call with an outcome: `failures` failed ones of the last `window`
    open it; `recovery` seconds after the last failure it lets `probes` through; one that succeeds closes it."""

    def step(state: dict, row: tuple) -> tuple:
        at, failed = row
        recent = state.setdefault("recent", deque(maxlen=window))
        mode = state.get("mode", "closed")
        if mode == "open" and at - state["failed_at"] > recovery:
            mode, state["tried"] = "half_open", 0
        called = mode == "closed" or (mode == "half_open" and state["tried"] < probes)
        if called:
            if mode == "half_open":
                state["tried"] += 1
            recent.append(failed)
            if failed:
                state["failed_at"] = at
                if sum(recent) >= failures:
                    mode = "open"
            elif mode == "half_open":
                mode = "closed"
        state["mode"] = mode
        return called, mode

    return step
