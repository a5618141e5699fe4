"""Keyed state of streams: the same rows as in batch after any split, restarts included."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvine.operators import evaluation, folds
from corvine.streaming import jobs, stateful

SCHEMA = "kind string, at timestamp, id long, value double, flag boolean"


def events(r, n, kinds=("a", "b", "c", None)):
    start = datetime(2024, 1, 1)
    at = lambda i: None if r.random() < 0.03 else start + timedelta(seconds=r.randrange(5000))
    return [(r.choice(kinds), at(i), 2**60 + i, None if r.random() < 0.1 else r.random() * 100, r.choice([True, False, None])) for i in range(n)]


def done(job):
    job.awaitTermination()
    assert job.exception() is None


@pytest.mark.parametrize("cuts", [[400], [1, 17, 18, 60, 400], [0, 399, 400]])
def test_last_rows_after_any_split(spark, tmp_path, cuts):
    rows = events(random.Random(len(cuts)), 400)
    begin = 0
    for cut in cuts:  # each part by a query of its own, started on the checkpoint of the one before
        spark.createDataFrame(rows[begin:cut], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        begin = cut
        done(stateful.last_window(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", "kind", ["at", "id"], 30, ["value"], ["flag"], "value"))
    got = jobs.latest(spark.read.parquet(f"{tmp_path}/out").withColumn("kind", F.coalesce("kind", F.lit("-"))), ["kind"])
    whole = evaluation.last_window(spark.createDataFrame(rows, SCHEMA), "kind", [F.desc("at"), F.desc("id")], 30, ["value"], ["flag"], "value").withColumn("kind", F.coalesce("kind", F.lit("-")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*got.columns).collect()))


def test_session_setting_stays(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(KeyError), stateful.state_store(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        raise KeyError
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_running_requests_and_idle_keys(spark, tmp_path):
    r = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(r.randrange(6), i, start + timedelta(seconds=20 * i + r.randrange(20)), float(r.randrange(0, 900))) for i in range(240)]
    rows += [(99, 1000, start + timedelta(days=3), 10.0)]  # long after: event time passes the end of all the others
    schema = "user long, request long, at timestamp, took double"
    states = []
    for part in (rows[:50], rows[50:51], rows[51:240], rows[240:], [(99, 1001, start + timedelta(days=5), 10.0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        with stateful.state_store(spark):
            admitted = stateful.admit_running(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "user", "request", "at", F.col("took"), 2, 300.0, "1 minute")
            job = admitted.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        done(job)
        states.append(max(p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress[-1:]))
    got = {(x.user, x.request, x.admitted, x.running) for x in spark.read.parquet(f"{tmp_path}/rows").where("request < 1001").collect()}
    plain = folds.fold(spark.createDataFrame(rows, schema).withColumn("s", F.unix_micros("at") / 1000000.0), "user", ["s", "request"], ["s", "took"], "admitted boolean, running int", folds.concurrency(2, 300.0))
    assert got == {(x.user, x.request, x.admitted, x.running) for x in plain.collect()}
    kept = spark.read.format("statestore").option("stateVarName", "ends").load(f"{tmp_path}/state").select("key.user").distinct().collect()
    print("rows of state after each part", states)
    assert {x.user for x in kept} == {99}
