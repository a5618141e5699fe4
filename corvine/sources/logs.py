"""JSON sources and sinks: metric logs, evaluation sets, collection backups, reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def history(spark: SparkSession, path: str, schema: str, at: str, days: int) -> DataFrame:
    """Rows of a JSON-lines log (folders by date) of the last `days` days up to its newest row. Unknown fields and broken lines are left
    out; the folders of earlier dates are not read."""
    rows = spark.read.schema(schema + ", date date").option("mode", "DROPMALFORMED").option("basePath", path).json(path)
    newest_date = rows.agg(F.max("date")).first()[0]
    if newest_date is None:
        return rows.drop("date")
    newest = rows.where(F.col("date") == F.lit(newest_date)).agg(F.max(at)).first()[0]
    edge = F.lit(newest) - F.expr(f"INTERVAL {days} DAYS")
    return rows.where((F.col("date") >= F.date_sub(F.lit(newest_date), days + 1)) & (F.col(at) >= edge)).drop("date")


EVALUATION = "version string, vector_db_id int, total_items int, items array<struct<id: int, query: string, relevant_document_ids: array<string>, relevant_chunk_ids: array<string>, source_content_preview: string, source_name: string>>"


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    """A row for each item of evaluation sets (one JSON document a file)."""
    return spark.read.schema(EVALUATION).json(path, multiLine=True).select("vector_db_id", F.explode("items").alias("i")).select("vector_db_id", "i.*")


BACKUP = "ids array<string>, documents array<string>, metadatas array<map<string,string>>"


def backup_rows(spark: SparkSession, path: str) -> DataFrame:
    """id, document, metadata of collection backups (parallel arrays, one JSON line a collection)."""
    zipped = F.arrays_zip(F.col("ids").alias("id"), F.col("documents").alias("document"), F.col("metadatas").alias("metadata"))
    return spark.read.schema(BACKUP).json(path).select(F.explode(zipped).alias("r")).select("r.*")


def write_backup(rows: DataFrame, path: str, part: str) -> None:
    """Rows (id, document, metadata) as JSON lines of parallel arrays, one for each value of the column `part`: a bounded share of a
    collection, by which its rows are dealt."""
    held = rows.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("id", "document", F.to_json("metadata").alias("metadata")))).alias("r"))
    held.select(F.col("r.id").alias("ids"), F.col("r.document").alias("documents"), F.transform("r.metadata", lambda m: F.from_json(m, "map<string,string>")).alias("metadatas")).write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small result (averages, settings) as one file of JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)
