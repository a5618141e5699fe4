"""Ingest with retries: what fails twice succeeds, what always fails is a row, a repeated batch changes nothing."""

import pytest

from corvine.streaming import ingest

SCHEMA = "doc_id string, text string"
GOOD = "A sentence that is long enough to be worth keeping in an index. " * 12


def parser(calls):
    """Notes each call as a file, as it runs in another process."""

    def parse(name, content, failures):
        open(f"{calls}/{name}-{failures}-{len(__import__('os').listdir(calls))}", "x").close()
        if name.startswith("never") or (name.startswith("twice") and failures < 2) or (name.startswith("once") and failures < 1):
            raise ValueError(f"not now: {name}")
        return content

    return parse


def run(spark, tmp_path, docs, **options):
    (tmp_path / "calls").mkdir(exist_ok=True)
    if docs:
        spark.createDataFrame(docs, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    job = ingest.ingest(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", parser(str(tmp_path / "calls")), strategy="fixed", size=300, overlap=0, **options)
    job.awaitTermination()
    assert job.exception() is None


def files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*.parquet")}


def test_retries_outcomes_and_chunks(spark, tmp_path):
    waits = []
    run(spark, tmp_path, [("a", GOOD), ("twice", GOOD), ("once", GOOD), ("never", GOOD), ("empty", ""), ("null", None), ("short", "hm"), ("menu", "\n".join(f"entry {i}" for i in range(40)))], wait=lambda n: waits.append(n) or 0.0)
    got = {r.doc_id: (r.status, r.step, r.n_attempts) for r in ingest.outcomes(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": ("success", None, 1), "twice": ("success", None, 3), "once": ("success", None, 2), "never": ("failed", "parsing", 4), "empty": ("failed", "text", 1), "null": ("failed", "text", 1), "short": ("failed", "text", 1), "menu": ("failed", "chunking", 1)}
    assert waits == [1, 2, 3]
    assert ingest.outcomes(spark, f"{tmp_path}/out").where("doc_id = 'never'").first().error == "ValueError: not now: never"
    chunks = ingest.chunks(spark, f"{tmp_path}/out").orderBy("doc_id", "chunk_index").collect()
    assert {c.doc_id for c in chunks} == {"a", "twice", "once"}
    own = [c for c in chunks if c.doc_id == "twice"]
    assert [c.chunk_index for c in own] == list(range(own[0].total_chunks)) and own[0].chunk_id == "twice_chunk_0"
    assert sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "calls").iterdir() if "never" in p.name) == [f"never-{n}" for n in range(4)]


def test_repeated_batch_and_restart(spark, tmp_path):
    import shutil

    run(spark, tmp_path, [("a", GOOD), ("twice", GOOD), ("never", GOOD)])
    before, calls = files(tmp_path / "out"), len(list((tmp_path / "calls").iterdir()))
    run(spark, tmp_path, [])  # nothing new
    shutil.rmtree(tmp_path / "state" / "commits")  # as if it had ended before it noted the batch: it is repeated
    run(spark, tmp_path, [])
    assert files(tmp_path / "out") == before and len(list((tmp_path / "calls").iterdir())) == calls
    # ended between rounds: the complete ones stay, the others are made again
    shutil.rmtree(tmp_path / "state" / "commits")
    for gone in ("outcomes/batch=0", "chunks/batch=0", "attempts/batch=0/round=3"):
        shutil.rmtree(tmp_path / "out" / gone)
    run(spark, tmp_path, [])
    assert len(list((tmp_path / "calls").iterdir())) == calls + 1  # round 3 of `never` alone
    assert {r.doc_id: r.n_attempts for r in ingest.outcomes(spark, f"{tmp_path}/out").collect()} == {"a": 1, "twice": 3, "never": 4}


def test_later_batches_take_over(spark, tmp_path):
    run(spark, tmp_path, [("a", GOOD), ("never", GOOD)])
    run(spark, tmp_path, [("a", "Another text that is now all there is to it, long enough to be kept."), ("b", GOOD)])
    run(spark, tmp_path, [("b", "x")])  # fails: its chunks stay
    chunks = ingest.chunks(spark, f"{tmp_path}/out").collect()
    assert [c.content[:12] for c in chunks if c.doc_id == "a"] == ["Another text"]
    assert {c.doc_id for c in chunks} == {"a", "b"}
    assert {r.doc_id: r.status for r in ingest.outcomes(spark, f"{tmp_path}/out").collect()} == {"a": "success", "b": "failed", "never": "failed"}
    assert [tuple(r)[1:5] for r in ingest.by_batch(spark, f"{tmp_path}/out").orderBy("batch").collect()] == [(2, 1, 1, 5), (2, 2, 0, 2), (1, 0, 1, 1)]


def test_progress(spark, tmp_path):
    import time

    seen = ingest.Progress()
    spark.streams.addListener(seen)
    try:
        run(spark, tmp_path, [("a", GOOD), ("b", GOOD)])
        broken = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in").selectExpr("raise_error('no') AS x").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/other").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no"):
            broken.awaitTermination()
        for _ in range(50):
            if {q["state"] for q in seen.queries.values()} == {"success", "failure"}:
                break
            time.sleep(0.2)
        states = sorted((q["state"], q["rows"]) for q in seen.queries.values())
        assert states == [("failure", 0), ("success", 2)] and any("no" in (q["error"] or "") for q in seen.queries.values())
    finally:
        spark.streams.removeListener(seen)
