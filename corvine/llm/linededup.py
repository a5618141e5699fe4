"""Exact line deduplication over all documents in DataFrame operations only.

Hashes of line keys are range-partitioned (with a salt made of the document, so that a line that a third
of the documents hold spreads over many ranges) and sorted by hash, document and position. Each range is
streamed once: a row whose document differs from the one before it is the first occurrence of the key in
that document. First occurrences are counted and the largest document kept per key. What comes back to
the documents is a run-length compressed keep bitmap each, no text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.common import cut, fresh

#: Blanks at both ends of a line: [\x20\x09-\x0D].
_BLANKS = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters besides A-Z that lower() would change.
_OTHER_CASED = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
SALTS = 16


def lines_of(text: Column) -> Column:
    """A text's lines; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z, only these, in lower case; lower() does that much
    faster than translate() where no other letter changes."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare.rlike(_OTHER_CASED), F.translate(bare, _UPPER, _LOWER)).otherwise(F.lower(bare))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """For each (doc_id, text_hash) that loses lines: runs, its keep bitmap as lengths of alternating runs
    (kept first, maybe 0), and n_dropped. text_hash is xxhash64(text): rows with one doc_id but different
    texts have bitmaps of their own, repeated rows share one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = rows.where(F.length(F.btrim("line", F.lit(_BLANKS))) >= min_chars).withColumn("key", line_key(F.col("line")))
    # Written once: the range sample, the ranges and the way back to the documents all read it.
    hashed = cut(keyed.select(F.xxhash64("key").alias("h"), F.hash("key").alias("h2"), F.pmod(F.hash("doc_id"), F.lit(SALTS)).cast("byte").alias("salt"), "doc_id", "text_hash", "pos"))
    stream = Window.partitionBy("h", "h2", "salt").orderBy("doc_id", "pos")
    before = F.lag(F.struct("doc_id")).over(stream)  # a struct: null only before the first row
    ranged = hashed.repartitionByRange(F.col("h"), F.col("h2"), F.col("salt"))
    firsts = ranged.withColumn("before", before).where(F.col("before").isNull() | ~F.col("before.doc_id").eqNullSafe(F.col("doc_id")))
    # Counted by salt first; the way back to the lines keeps the salt, so that no task meets all lines of a frequent key.
    parts = firsts.groupBy("h", "h2", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    of_key = Window.partitionBy("h", "h2")
    held = parts.select("h", "h2", "salt", F.sum("n").over(of_key).alias("n"), F.max("keeper").over(of_key).alias("keeper")).where(F.col("n") >= min_docs)
    dropped = hashed.join(held, ["h", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    by_doc = dropped.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    # Dropped positions p0 < p1 < ... as runs: kept up to p0, one dropped, kept up to p1, ...; a kept run of 0 joins its neighbours on expansion.
    step = F.transform("gone", lambda p, i: F.array(p - F.when(i == 0, F.lit(0)).otherwise(F.element_at("gone", F.greatest(i, F.lit(1))) + 1), F.lit(1)))
    return by_doc.select("doc_id", "text_hash", F.flatten(step).alias("runs"), F.size("gone").cast("long").alias("n_dropped"))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines that a keep bitmap keeps; a null bitmap keeps all. Lines behind the last run are kept."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    marked = F.filter(F.arrays_zip(lines.alias("line"), flags.alias("keep")), lambda x: x["line"].isNotNull() & F.coalesce(x["keep"], F.lit(True)))
    return F.when(runs.isNull(), lines).otherwise(F.transform(marked, lambda x: x["line"]))


def _deduped(docs: DataFrame, min_chars: int, min_docs: int, n_lines: str, n_dropped: str, runs: str) -> DataFrame:
    """docs with text as dedup_lines gives it, and three further columns of these names, which docs doesn't have."""
    own, text_hash = fresh(docs, "own_id"), fresh(docs, "own_hash")
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash), F.col("runs").alias(runs), F.col("n_dropped").alias(n_dropped))
    met = docs.join(bitmaps, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines, F.col(runs)), "\n"))
    return met.withColumns({n_lines: F.size(lines).cast("long"), n_dropped: F.coalesce(n_dropped, F.lit(0).cast("long")), "text": kept}).drop(own, text_hash)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the columns it has, text with its kept lines joined by a line feed. No other column changes, whatever its name.

    Keys of min_chars code points or more that min_docs documents hold (distinct doc_id) lose all their
    lines but those of the largest doc_id. A null doc_id counts as one document that is never the
    largest. A null text stays null. Empty tables give an empty result.
    """
    names = [fresh(docs, n) for n in ("n_lines", "n_dropped", "runs")]
    return _deduped(docs, min_chars, min_docs, *names).drop(*names)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and keep_runs (the bitmap's runs; empty: all kept) of each document. A null text has one line."""
    done = _deduped(docs.select("doc_id", "text"), 20, 3, "n_lines", "n_dropped", "runs")
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.coalesce(F.array_join("runs", ","), F.lit("")).alias("keep_runs"))
