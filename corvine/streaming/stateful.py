"""Streams with state of their own for each key: the last n rows, and limits on what runs at once.

State lies in RocksDB under the query's checkpoint (`state_store` sets that up), so its size doesn't matter for an executor's memory, and a query that is
started again goes on where it ended. A key's state is bounded: n rows, or as many numbers as the limit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which keyed state needs; the session's own setting stays as it is."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _newness(order: list[str]):
    """Sorts rows from old to new; a null is older than any value."""
    return lambda row: tuple((row[c] is not None, row[c]) if row[c] is not None else (False, 0) for c in order)


def _micros(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)").alias(name)
    return F.unix_micros(name).alias(name) if isinstance(kind, T.TimestampType) else F.col(name)


def _time(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, `{name}` / 1000000)").alias(name)
    return F.timestamp_micros(name).alias(name) if isinstance(kind, T.TimestampType) else F.col(name)


class LastRows(StatefulProcessor):
    """The n newest rows of a key as list state; what comes out of a batch is those rows, for each key that had any in it."""

    def __init__(self, n: int, order: list[str], kept: T.StructType, group: str) -> None:
        self.n, self.order, self.kept, self.group = n, order, kept, group

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.kept)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        names = self.kept.names
        held = [Row(**dict(zip(names, old, strict=True))) for old in self.rows.get()] if self.rows.exists() else []
        newness = _newness(self.order)
        both = (row for part in (held, (Row(**{c: r[c] for c in names}) for r in rows)) for row in part)
        newest = heapq.nlargest(self.n, both, key=newness)
        self.rows.put([tuple(r[c] for c in names) for r in newest])
        for row in newest:
            yield Row(**{self.group: key[0]}, **row.asDict())

    def close(self) -> None:
        pass


def last_rows(rows: DataFrame, group: str, order: list[str], n: int, columns: list[str]) -> DataFrame:
    """Of each batch the n newest rows so far (by the columns `order`, ties in any way) of the groups that have rows in it: group, order, columns. Whatever the
    rows are split into, the last batch of a group has its last n rows. The rows of a batch are first cut to n of each group in every Arrow batch of every
    task, so that a group that has a third of all rows sends a few of them."""
    names = list(dict.fromkeys([group, *order, *columns]))
    kinds = {f.name: f.dataType for f in rows.schema}
    # times are kept as microseconds: state gives them back in another time zone than rows
    rows = rows.select(*[_micros(c, kinds[c]) for c in names])

    def newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_age = pc.sort_indices(batch, sort_keys=[(c, "descending") for c in order], null_placement="at_end")
            groups = pd.Series(batch.column(group).dictionary_encode().indices.fill_null(-1).take(by_age).to_numpy(zero_copy_only=False))
            yield batch.take(by_age.filter(pa.array((groups.groupby(groups).cumcount() < n).to_numpy())))

    fewer = rows.mapInArrow(newest, rows.schema)
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name != group])
    schema = T.StructType([f for f in rows.schema if f.name == group] + kept.fields)
    newest_rows = fewer.groupBy(group).transformWithState(LastRows(n, order, kept, group), schema, "Update", "None")
    return newest_rows.select(*[_time(c, kinds[c]) for c in names])


def last_window(rows: DataFrame, out: str, checkpoint: str, group: str, order: list[str], n: int, means: list[str], flags: list[str], total: str, **options) -> StreamingQuery:
    """The same averages, rates and p95 as evaluation.last_window, kept up to date: each batch writes those of the groups that it changed to out/batch=number (see
    jobs.latest). options of the trigger; by default all there is."""
    from corvine.operators.evaluation import last_window as of_batch

    newest = last_rows(rows, group, order, n, list(dict.fromkeys([*means, *flags, total])))

    def write(batch: DataFrame, number: int) -> None:
        of_batch(batch, group, [F.desc(c) for c in order], n, means, flags, total).write.mode("overwrite").parquet(f"{out}/batch={number}")

    with state_store(rows.sparkSession):
        return newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


class Places(StatefulProcessor):
    """Admits a request while fewer than `limit` admitted ones of its key still run. A timer at the end of the last one removes the key's state."""

    def __init__(self, limit: int, ttl: float, key: str, request: str, at: str) -> None:
        self.limit, self.ttl, self.names = limit, ttl, (key, request, at)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getListState("ends", "end double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        of_key, request, at = self.names
        ends = [e[0] for e in self.ends.get()] if self.ends.exists() else []
        for row in sorted(rows, key=lambda r: (r["seconds"], r[request])):
            ends = [e for e in ends if e > row["seconds"]]
            admitted = len(ends) < self.limit
            if admitted:
                ends.append(row["seconds"] + min(row["duration"], self.ttl))
            yield Row(**{of_key: key[0], request: row[request], at: row[at], "admitted": admitted, "running": len(ends)})
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ends:
            self.ends.put([(e,) for e in ends])
            self.handle.registerTimer(int(max(ends) * 1000) + 1)
        else:
            self.ends.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        """Event time has passed the end of all that ran: the key is idle."""
        self.ends.clear()
        yield from ()

    def close(self) -> None:
        pass


def admit_running(requests: DataFrame, key: str, request: str, at: str, duration: Column, limit: int, ttl: float, late: str = "1 hour") -> DataFrame:
    """key, request, at, admitted, running of each request: an admitted one holds one of `limit` places of its key for its duration (seconds), `ttl` seconds at most.

    State: the ends of what runs, `limit` numbers at most. When event time has passed the last of them, a timer removes them, so idle keys
    leave the state. The requests of a key in one batch are taken in the order of time and request; batches follow each other. Start it in `state_store`.
    """
    kinds = {f.name: f.dataType for f in requests.schema}
    timed = requests.withColumn(at, F.col(at).cast("timestamp")).select(key, request, at, (F.unix_micros(at) / 1000000.0).alias("seconds"), duration.cast("double").alias("duration")).withWatermark(at, late)
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField(request, kinds[request]), T.StructField(at, T.TimestampType()), T.StructField("admitted", T.BooleanType()), T.StructField("running", T.IntegerType())])
    return timed.groupBy(key).transformWithState(Places(limit, ttl, key, request, at), schema, "Append", "EventTime")
