"""The corpus pipeline: five stages over all documents, each on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; the last adds each text's pieces.
SQL can't express the first stage, so the pipeline has no SQL and is tested against a plain version.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import decontam, linededup, sentencepiece, simhash, toxicity
from corvine.llm.common import fresh, shared_folder
from corvine.llm.queries import TOKENIZERS
from corvine.sources.tables import spread, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars, where there is such a column, becomes the length of what is left."""
    kept = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays. The deletion variants are those of the SimHash operator,
    over least hashes in place of its bits (see simhash.without_similar)."""
    return simhash.without_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids (the pieces of the text) and n_tokens; a document's own columns of these names stay, the new ones get underscores before theirs."""
    ids, number = fresh(docs, "ids"), fresh(docs, "n_tokens")
    held = {c: fresh(docs, f"held_{c}") for c in docs.columns if c.lower() == "ids"}
    done = sentencepiece.encode(docs.withColumnsRenamed(held), sentencepiece.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")).withColumnRenamed("ids", ids)
    return done.withColumnsRenamed({v: k for k, v in held.items()}).withColumn(number, F.size(ids).cast("long"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents; the tables between them lie in the shared checkpoint folder."""
    docs = spread(table(spark, sf_dir, "documents"))
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
