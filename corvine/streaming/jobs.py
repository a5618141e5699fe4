"""Structured Streaming jobs: incremental ingest, event-time monitoring, admission control.

Jobs take a streaming frame and the folders of their output and checkpoint, which lie in a store that driver
and executors share. With availableNow they end when all input there is has been read; run again, they
go on where they ended. Sinks are written by batch number, so that a repeated batch writes the same files.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvine.operators.chunks import chunk


def _run(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(docs: DataFrame, out: str, checkpoint: str, key: str = "doc_id", keep: Column | None = None, **options) -> StreamingQuery:
    """Chunks of the documents that arrive (for which `keep` holds), written to out/batch=n; options are those of chunk()."""
    fresh = docs if keep is None else docs.where(keep)

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch, key, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _run(fresh.writeStream.foreachBatch(write), checkpoint)


def latest(out_batches: DataFrame, key: list[str]) -> DataFrame:
    """Of rows that several batches (column batch) have written, those of the last batch that has their key: an upsert on reading."""
    last = out_batches.groupBy(*key).agg(F.max("batch").alias("batch"))
    return out_batches.join(last, [*key, "batch"]).drop("batch")


def monitor(events: DataFrame, out: str, checkpoint: str, at: str, group: str, value: str, length: str = "1 day", late: str = "1 hour", flag: Column | None = None) -> StreamingQuery:
    """window_start, group, n, avg_value, max_value, n_flagged for each window of event time; events later than `late` behind the newest
    are dropped with their state. Each batch writes the windows it has changed to out/batch=n (see latest)."""
    flagged = F.count_if(flag if flag is not None else F.lit(False))
    windows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, length).alias("w"), group)
    stats = windows.agg(F.count("*").alias("n"), F.round(F.avg(value), 8).alias("avg_value"), F.max(value).alias("max_value"), flagged.alias("n_flagged"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("window_start"), group, "n", "avg_value", "max_value", "n_flagged").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _run(stats.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def admit(requests: DataFrame, key: str, at: str, limit: int, window: float, late: str = "1 hour") -> DataFrame:
    """key, request_id, at, admitted for each request (key, request_id, at: a timestamp): `limit` admitted ones in any `window` seconds.

    The state of a key is the times of its admitted requests in the window, `limit` numbers at most; it goes when event
    time has passed the last of them by the window. The requests of a key in one batch are taken in the order of time.
    """
    kinds = dict(requests.dtypes)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(parts).sort_values([at, "request_id"], ignore_index=True)
        admitted = []
        for now in rows[at].astype("datetime64[us]").astype("int64") / 1e6:
            log = [t for t in log if t > now - window]
            admitted.append(len(log) < limit)
            if admitted[-1]:
                log.append(now)
        state.update((log,))
        state.setTimeoutTimestamp(max(int((max(log, default=0) + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(admitted=admitted)[[key, "request_id", at, "admitted"]]

    schema = f"{key} {kinds[key]}, request_id {kinds['request_id']}, {at} timestamp, admitted boolean"
    timed = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(key).applyInPandasWithState(step, schema, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def append_log(events: DataFrame, out: str, checkpoint: str, at: str) -> StreamingQuery:
    """Events as JSON lines in a folder for each day."""
    dated = events.withColumn("date", F.to_date(at))
    return _run(dated.writeStream.format("json").partitionBy("date").option("path", out).outputMode("append"), checkpoint)


def sessions(events: DataFrame, out: str, checkpoint: str, at: str, group: str, value: str, gap: str = "30 minutes", late: str = "1 hour") -> StreamingQuery:
    """session_start, session_end (the last event and the gap), group, n, total of the sessions (events at most the gap apart) that are closed: event time, which follows the newest event by `late`, has passed
    their end. Parquet under out. Rows that come later than that are left out; progress of the query counts them (see ingest.Progress). Open sessions stay in the state."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    closed = timed.groupBy(F.session_window(at, gap).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    rows = closed.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), group, "n", "total")
    return _run(rows.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
