"""Queries of the streaming jobs and of the folds over ordered rows. Streams read a table's files and end with them."""

from pyspark.sql import functions as F

from corvine.operators import evaluation, folds
from corvine.operators.registry import query
from corvine.plans.chunks import fixed_sql
from corvine.plans.evaluation import LAST200
from corvine.sources import logs
from corvine.sources.folders import shared_folder
from corvine.streaming import exposition, ingest, jobs, stateful


def finished(job):
    job.awaitTermination()
    if job.exception() is not None:
        raise job.exception()


@query(f"WITH RECURSIVE {fixed_sql(1000, 100)} SELECT doc_id, chunk_index, content FROM fixed JOIN documents USING (doc_id) WHERE n_chars >= 200")
def stream_ingest_chunks(t):
    spark = t.spark
    out = shared_folder(spark, "ingest")
    finished(jobs.ingest(t.stream("documents"), f"{out}/chunks", f"{out}/state", keep=F.col("n_chars") >= 200, strategy="fixed", size=1000, overlap=100))
    return jobs.latest(spark.read.parquet(f"{out}/chunks"), ["doc_id"]).select("doc_id", "chunk_index", "content")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 8) AS avg_value, max(value) AS max_value, count(*) FILTER (value > 50) AS n_flagged FROM events GROUP BY ALL")
def stream_monitor_window(t):
    spark = t.spark
    out = shared_folder(spark, "monitor")
    finished(jobs.monitor(t.stream("events"), f"{out}/windows", f"{out}/state", "ts", "event_type", "value", flag=F.col("value") > 50))
    return jobs.latest(spark.read.parquet(f"{out}/windows"), ["window_start", "event_type"])


ADMITTED = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, sec, [sec] AS log, true AS admitted FROM o WHERE n = 1 UNION ALL
      SELECT user_id, event_id, n, sec, CASE WHEN len(live) < 2 THEN list_append(live, sec) ELSE live END, len(live) < 2 FROM (SELECT o.*, list_filter(f.log, lambda x: x > o.sec - 86400) AS live FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
    SELECT user_id, event_id, admitted FROM f"""


def seconds(column="ts"):
    return (F.unix_micros(F.col(column).cast("timestamp")) / 1000000.0).alias("at")


@query(ADMITTED)
def stream_admission(t):
    spark = t.spark
    out = shared_folder(spark, "admission")
    requests = t.stream("events").select("user_id", F.col("event_id").alias("request_id"), "ts")
    admitted = jobs.admit(requests, "user_id", "ts", 2, 86400)
    finished(admitted.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/rows").select("user_id", F.col("request_id").alias("event_id"), "admitted")


@query(ADMITTED)
def rate_limit_admission(t):
    rows = t("events").select("user_id", "event_id", seconds())
    return folds.fold(rows, "user_id", ["at", "event_id"], ["at"], "admitted boolean, remaining int, retry_after long", folds.sliding_log(2, 86400)).select("user_id", "event_id", "admitted")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, sec, 2.0::DOUBLE AS tokens, true AS admitted FROM o WHERE n = 1 UNION ALL
      SELECT user_id, event_id, n, sec, have - (have >= 1)::INTEGER, have >= 1 FROM (SELECT o.*, least(3.0::DOUBLE, f.tokens + (o.sec - f.sec) * 0.00002::DOUBLE) AS have FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
    SELECT user_id, event_id, admitted FROM f""")
def token_bucket_admission(t):
    rows = t("events").select("user_id", "event_id", seconds())
    return folds.fold(rows, "user_id", ["at", "event_id"], ["at"], "admitted boolean, tokens double", folds.token_bucket(0.00002, 3)).select("user_id", "event_id", "admitted")


@query("""WITH RECURSIVE o AS (SELECT event_type, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS sec, value > 30 AS failed, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT event_type, 0::BIGINT AS event_id, 0::BIGINT AS n, 'closed' AS mode, []::BOOLEAN[] AS recent, 0.0::DOUBLE AS failed_at, 0 AS tried, false AS called FROM (SELECT DISTINCT event_type FROM events)
      UNION ALL SELECT event_type, event_id, n, CASE WHEN NOT called THEN m WHEN failed AND list_sum(list_transform(last, lambda x: x::INTEGER)) >= 5 THEN 'open' WHEN failed THEN m ELSE 'closed' END, last, CASE WHEN called AND failed THEN sec ELSE failed_at END, tried + (called AND m = 'half_open')::INTEGER, called
      FROM (SELECT *, CASE WHEN called THEN list_append(recent, failed)[-10:] ELSE recent END AS last FROM (SELECT *, m = 'closed' OR m = 'half_open' AND tried < 3 AS called
        FROM (SELECT o.event_type, o.event_id, o.n, o.sec, o.failed, f.recent, f.failed_at, CASE WHEN f.mode = 'open' AND o.sec - f.failed_at > 3600 THEN 0 ELSE f.tried END AS tried, CASE WHEN f.mode = 'open' AND o.sec - f.failed_at > 3600 THEN 'half_open' ELSE f.mode END AS m FROM f JOIN o ON o.event_type = f.event_type AND o.n = f.n + 1))))
    SELECT event_type, event_id, called, mode AS state FROM f WHERE n > 0""")
def circuit_breaker_states(t):
    rows = t("events").select("event_type", "event_id", seconds(), (F.col("value") > 30).alias("failed"))
    return folds.fold(rows, "event_type", ["at", "event_id"], ["at", "failed"], "called boolean, state string", folds.circuit_breaker(recovery=3600.0)).select("event_type", "event_id", "called", "state")


RUNNING = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS sec, least(value * 3600, 86400.0::DOUBLE) AS dur, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, [sec + dur] AS ends, true AS admitted FROM o WHERE n = 1 UNION ALL
      SELECT user_id, event_id, n, CASE WHEN len(live) < 2 THEN list_append(live, sec + dur) ELSE live END, len(live) < 2 FROM (SELECT o.*, list_filter(f.ends, lambda x: x > o.sec) AS live FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
    SELECT user_id, event_id, admitted, len(ends)::INTEGER AS running FROM f"""


@query(RUNNING)
def concurrency_admission(t):
    rows = t("events").select("user_id", "event_id", seconds(), (F.col("value") * 3600).alias("duration"))
    return folds.fold(rows, "user_id", ["at", "event_id"], ["at", "duration"], "admitted boolean, running int", folds.concurrency(2, 86400.0)).select("user_id", "event_id", "admitted", "running")


@query("SELECT event_id, event_type, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def metrics_history(t):
    """Events appended as JSON lines by day, and the last seven days read again."""
    spark = t.spark
    out = shared_folder(spark, "metrics")
    finished(jobs.append_log(t.stream("events"), f"{out}/log", f"{out}/state", "ts"))
    return logs.history(spark, f"{out}/log", "event_id long, ts timestamp, user_id long, event_type string, value double, props string", "ts", 7).select("event_id", "event_type", "value")


@query(LAST200)
def stream_last200(t):
    """Events that arrive in three parts, none of them in the order of time; the job is started anew for each."""
    out, events = shared_folder(t.spark, "last200"), t("events")
    for part in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(f"{out}/in")
        arriving = t.spark.readStream.schema(events.schema).parquet(f"{out}/in").withColumn("low", F.col("value") < 5)
        finished(stateful.last_window(arriving, f"{out}/stats", f"{out}/state", "event_type", ["ts", "event_id"], 200, ["value"], ["low"], "value"))
    return jobs.latest(t.spark.read.parquet(f"{out}/stats"), ["event_type"])


@query(RUNNING)
def stream_concurrency(t):
    """Events that arrive in three parts of time; the job is started anew for each."""
    out, events = shared_folder(t.spark, "running"), t("events")
    first, last = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    third = F.least(F.lit(2), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(first)) * 3 / F.lit(max(1, (last or 0) - (first or 0)))))
    for part in range(3):
        events.where(third == part).write.mode("append").parquet(f"{out}/in")
        arriving = t.spark.readStream.schema(events.schema).parquet(f"{out}/in")
        admitted = stateful.admit_running(arriving, "user_id", "event_id", "ts", F.col("value") * 3600, 2, 86400.0)
        with stateful.state_store(t.spark):
            job = admitted.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        finished(job)
    return t.spark.read.parquet(f"{out}/rows").select("user_id", "event_id", "admitted", "running")


def unsteady(doc_id, text, failures):
    """Stands in for a parser: some documents fail twice, some always."""
    if doc_id % 11 == 5 or (doc_id % 11 == 3 and failures < 2):
        raise OSError(f"no answer for {doc_id}")
    return text


@query(f"""WITH RECURSIVE {fixed_sql(1000, 100)}, n AS (SELECT doc_id, count(*)::INTEGER AS n FROM fixed GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id % 11 = 5 OR n_chars < 300 THEN 'failed' ELSE 'success' END AS status, CASE WHEN doc_id % 11 = 5 THEN 'parsing' WHEN n_chars < 300 THEN 'text' END AS step,
      CASE WHEN doc_id % 11 = 5 THEN 4 WHEN doc_id % 11 = 3 THEN 3 ELSE 1 END AS n_attempts, CASE WHEN doc_id % 11 = 5 THEN 'OSError: no answer for ' || doc_id WHEN n_chars < 300 THEN 'too little text' END AS error,
      CASE WHEN doc_id % 11 = 5 OR n_chars < 300 THEN 0 ELSE n END AS n_chunks FROM documents LEFT JOIN n USING (doc_id)""")
def stream_ingest_retries(t):
    out = shared_folder(t.spark, "retries")
    finished(ingest.ingest(t.stream("documents"), out, f"{out}/state", unsteady, clean=None, gate=lambda text: F.length(text) >= 300, keep=None, size=1000, overlap=100))
    return ingest.outcomes(t.spark, out)


@query("""WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS island FROM o)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, user_id, count(*) AS n, round(sum(value), 6) AS total FROM i GROUP BY user_id, island
    HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(t):
    """Sessions of users, of those that are closed when the stream ends."""
    out = shared_folder(t.spark, "sessions")
    finished(jobs.sessions(t.stream("events"), f"{out}/rows", f"{out}/state", "ts", "user_id", "value", "12 hours", "1 hour"))
    return t.spark.read.parquet(f"{out}/rows").withColumn("total", F.round("total", 6))


def metrics():
    return [
        exposition.Counter("queries_total", "Queries by method", "retrieval_method", F.col("event_type")),
        exposition.Counter("low_confidence_total", "Queries of low confidence", when=F.col("value") < 5),
        exposition.Histogram("stage_latency_milliseconds", "Latency by stage", {"total": F.col("value"), "retrieval": F.col("value") / 2}, tuple(evaluation.LATENCY_BUCKETS), "stage"),
        exposition.Histogram("top1_similarity", "Similarity of the first result", {None: F.col("value") / 100}, tuple(evaluation.RATIO_BUCKETS), low=0.0, high=1.0),
    ]


_BUCKETS = lambda series, value, bounds: f"SELECT {series} AS series, b AS le, count(*) FILTER ({value} <= b)::DOUBLE AS value FROM events, (SELECT unnest({bounds}) AS b) GROUP BY b"
_WHOLE = lambda name, label, series, value: f"SELECT '{name}', 'total', {label}, {series}, NULL, count({value})::DOUBLE FROM events UNION ALL SELECT '{name}', 'sum', {label}, {series}, NULL, sum({value}) FROM events"
_CUT = "least(1.0, greatest(0.0, value / 100))"


@query(f"""WITH r AS (SELECT 'queries_total' AS name, 'count' AS kind, 'retrieval_method' AS label, coalesce(event_type, 'none') AS series, NULL::DOUBLE AS le, count(*)::DOUBLE AS value FROM events GROUP BY event_type
    UNION ALL SELECT 'low_confidence_total', 'count', NULL, NULL, NULL, count(*) FILTER (value < 5)::DOUBLE FROM events
    UNION ALL SELECT 'stage_latency_milliseconds', 'bucket', 'stage', * FROM ({_BUCKETS("'total'", "value", evaluation.LATENCY_BUCKETS)})
    UNION ALL SELECT 'stage_latency_milliseconds', 'bucket', 'stage', * FROM ({_BUCKETS("'retrieval'", "value / 2", evaluation.LATENCY_BUCKETS)})
    UNION ALL SELECT 'top1_similarity', 'bucket', NULL, * FROM ({_BUCKETS("NULL", _CUT, evaluation.RATIO_BUCKETS)})
    UNION ALL {_WHOLE("stage_latency_milliseconds", "'stage'", "'total'", "value")} UNION ALL {_WHOLE("stage_latency_milliseconds", "'stage'", "'retrieval'", "value / 2")} UNION ALL {_WHOLE("top1_similarity", "NULL", "NULL", _CUT)})
    SELECT name, kind, label, series, le, round(value, 6) AS value FROM r""")
def metrics_totals(t):
    """Events as query records that arrive in three parts; the job is started anew for each."""
    out, events = shared_folder(t.spark, "exposition"), t("events")
    for part in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(f"{out}/in")
        finished(exposition.accumulate(t.spark.readStream.schema(events.schema).parquet(f"{out}/in"), f"{out}/counts", f"{out}/state", metrics()))
    return exposition.totals(t.spark, f"{out}/counts").select("name", "kind", "label", "series", "le", F.round("value", 6).alias("value"))
