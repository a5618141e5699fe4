"""Ingest with retries: documents that arrive are parsed, cleaned, gated, chunked; what fails is tried again, what fails for good is a row of its own.

A batch goes through rounds. In each, only the documents that failed in the round before are parsed again; what a round gave is written under
attempts/batch=b/round=r before the next one begins, so a batch that is repeated after a crash reads the rounds that are complete and parses nothing twice.
All tables are written by batch number, and a repeated batch writes the same files. The latest batch of a document counts (see chunks and outcomes).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from corvine.functions import text as f
from corvine.operators.chunks import STRATEGIES, pieces
from corvine.streaming.jobs import latest

#: Parses a document: its key, its content and how often it failed before; gives its text or raises.
Parser = Callable[[object, object, int], str | None]


def _complete(spark: SparkSession, path: str) -> bool:
    """A table was written there to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def attempted(docs: DataFrame, key: str, content: str, parse: Parser, failures: int) -> DataFrame:
    """key, given (the content; null once it is parsed), text, error of each document."""

    @F.udf("struct<text:string,error:string>", useArrow=True)
    def run(name, given):
        try:
            return parse(name, given, failures), None
        except Exception as error:  # a document's failure is its own, whatever its kind
            return None, f"{type(error).__name__}: {error}"[:500]

    tried = docs.select(key, F.col(content).alias("given"), run.asNondeterministic()(F.col(key), F.col(content)).alias("t"))
    return tried.select(key, F.when(F.col("t.error").isNotNull(), F.col("given")).alias("given"), "t.text", "t.error")


def rounds(docs: DataFrame, path: str, key: str, content: str, parse: Parser, retries: int = 3, wait: Callable[[int], float] = lambda failures: 0.0) -> DataFrame:
    """key, given, text, error, round of each attempt: all documents in round 0, in each further one those that failed before. Rounds that lie complete under
    the path are not made again. wait: seconds before the next round, by how often its documents have failed."""
    spark = docs.sparkSession
    for number in range(retries + 1):
        here = f"{path}/round={number}"
        if not _complete(spark, here):
            if number:
                time.sleep(wait(number))
            attempted(docs, key, content, parse, number).write.mode("overwrite").parquet(here)
        done = spark.read.parquet(here)
        docs, content = done.where("error IS NOT NULL").select(key, "given"), "given"
        if docs.isEmpty():
            break
    return spark.read.option("basePath", path).parquet(*[f"{path}/round={n}" for n in range(number + 1)])


def ingest(
    docs: DataFrame, out: str, checkpoint: str, parse: Parser, key: str = "doc_id", content: str = "text", retries: int = 3, wait: Callable[[int], float] = lambda failures: 0.0,
    clean: Callable[[Column], Column] | None = f.clean_document, gate: Callable[[Column], Column] | None = f.worth_indexing, keep: Callable[[Column], Column] | None = f.quality_chunk, strategy: str = "fixed", **options,
) -> StreamingQuery:
    """Starts a job over the documents that arrive (key, content; a key once a batch); it ends when all there is has been read.

    A document fails at a step: parsing (its parser raised `retries` + 1 times), text (none, or the gate refuses it once it is clean), chunking (no
    chunk is worth keeping). Only parsing is tried again: the other steps would do the same. Tables under out: attempts; chunks (key, chunk_index,
    content, total_chunks, chunk_id, of the chunks that are kept); outcomes (key, status, step, n_attempts, error, n_chunks).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")

    def write(batch: DataFrame, number: int) -> None:
        if _complete(batch.sparkSession, f"{out}/outcomes/batch={number}"):
            return
        tries = rounds(batch.select(key, content), f"{out}/attempts/batch={number}", key, content, parse, retries, wait)
        last = tries.groupBy(key).agg(F.max("round").alias("round"))
        final = tries.join(last, [key, "round"])
        text = clean(F.col("text")) if clean else F.col("text")
        cleaned = final.select(key, F.col("round"), "error", text.alias("text"))
        worth = F.coalesce(gate(F.col("text")) if gate else f.strip(F.col("text")) != "", F.lit(False))
        found = pieces(F.col("text"), strategy, **options)
        cut = cleaned.select(key, "round", "error", worth.alias("worth"), F.when(F.col("error").isNull() & worth, F.filter(found, lambda c: keep(c)) if keep else found).alias("c"))
        cut.write.mode("overwrite").parquet(f"{out}/pieces/batch={number}")  # read twice below
        cut = batch.sparkSession.read.parquet(f"{out}/pieces/batch={number}")
        named = F.concat_ws("_chunk_", F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id")
        cut.select(key, F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "content")).select(key, "chunk_index", "content", "total_chunks", named).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        step = F.when(F.col("error").isNotNull(), "parsing").when(~F.col("worth"), "text").when(F.size("c") == 0, "chunking")
        error = F.when(step == "text", "too little text").when(step == "chunking", "no chunk is worth keeping").otherwise(F.col("error"))
        outcome = cut.select(key, F.when(step.isNull(), "success").otherwise("failed").alias("status"), step.alias("step"), (F.col("round") + 1).cast("int").alias("n_attempts"), error.alias("error"), F.greatest(F.lit(0), F.coalesce(F.size("c"), F.lit(0))).alias("n_chunks"))
        outcome.write.mode("overwrite").parquet(f"{out}/outcomes/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """How it went with each document, the last time it came; failed ones are the rows whose status is `failed`."""
    return latest(spark.read.parquet(f"{out}/outcomes"), [key])


def chunks(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """The chunks of each document from the last batch in which it succeeded: a document that fails later keeps those it has."""
    last = spark.read.parquet(f"{out}/outcomes").where("status = 'success'").groupBy(key).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/chunks").join(last, [key, "batch"]).drop("batch")


def by_batch(spark: SparkSession, out: str) -> DataFrame:
    """batch, n_docs, n_success, n_failed, n_attempts, n_chunks of each batch that is done."""
    done = spark.read.parquet(f"{out}/outcomes")
    return done.groupBy("batch").agg(F.count("*").alias("n_docs"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.sum("n_attempts").alias("n_attempts"), F.sum("n_chunks").alias("n_chunks"))


class Progress(StreamingQueryListener):
    """What the queries of a session are at, by their id: state (started, progress, success, failure), batches, rows, late (rows that state refused as too late), error. Add it with
    spark.streams.addListener; of: only queries of this name."""

    def __init__(self, of: str | None = None) -> None:
        self.of, self.queries = of, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if self.of in (None, event.name):
            self.queries[str(event.id)] = {"state": "started", "batches": 0, "rows": 0, "late": 0, "error": None}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if (seen := self.queries.get(str(event.progress.id))) is None:
            return
        seen["late"] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        if event.progress.numInputRows:
            seen["state"], seen["batches"], seen["rows"] = "progress", seen["batches"] + 1, seen["rows"] + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if (seen := self.queries.get(str(event.id))) is not None:
            seen["state"], seen["error"] = ("success", None) if event.exception is None else ("failure", event.exception[:500])
