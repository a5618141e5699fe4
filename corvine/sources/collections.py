"""Collections of chunks with vectors as Parquet partitioned by collection: one table for writing and reading."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.sources.folders import shared_folder

SCHEMA = "chunk_id string, content string, embedding array<float>, document_id string, source string, publish_year string, department string, metadata map<string,string>, kb_id long"


class Collections:
    """Collections (kb_id) under a path that all executors share. Changes write the partitions they touch anew, from a snapshot, so a
    reader of files sees the old rows or the new ones of a collection."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, *kb_ids: int) -> DataFrame:
        """All chunks, or those of some collections: only their folders are read."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.where(F.col("kb_id").isin(list(kb_ids))) if kb_ids else rows

    def append(self, rows: DataFrame) -> None:
        """Dealt by collection and a hash of the chunk, so that a large collection is many files and a small one few."""
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], SCHEMA).schema]
        rows.select(*fields).write.partitionBy("kb_id").mode("append").parquet(self.path)

    def _replace(self, changed: DataFrame, snapshot: str | None) -> None:
        snapshot = snapshot or shared_folder(self.spark, "snapshot")
        changed.write.partitionBy("kb_id").mode("overwrite").parquet(snapshot)
        self.spark.read.schema(SCHEMA).parquet(snapshot).write.option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").mode("overwrite").parquet(self.path)

    def upsert(self, rows: DataFrame, snapshot: str | None = None) -> None:
        """Chunks of rows take the place of those with their collection and id; collections without a change aren't written."""
        touched = [r[0] for r in rows.select("kb_id").distinct().collect()]
        kept = self.read(*touched).join(rows.select("kb_id", "chunk_id"), ["kb_id", "chunk_id"], "left_anti")
        columns = kept.columns
        new = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(dict(kept.dtypes)[c]).alias(c) for c in columns])
        self._replace(kept.select(*columns).unionByName(new), snapshot)

    def delete(self, kb_id: int, removed: DataFrame, on: list[str], snapshot: str | None = None) -> None:
        """Takes out the chunks of a collection that match removed on the columns `on` (document_id, chunk_id, …)."""
        kept = self.read(kb_id).join(removed.select(*on).distinct(), on, "left_anti")
        if kept.isEmpty():
            self.drop(kb_id)
        else:
            self._replace(kept.select(*self.read().columns), snapshot)

    def rebuild(self, kb_id: int, change: Callable[[DataFrame], DataFrame], backup: str, snapshot: str) -> dict[str, int]:
        """Writes a collection anew as `change` makes it (cleaned, gated, with new vectors), after a backup of it as it was; original, kept, rejected."""
        columns = self.read().columns
        self.read(kb_id).write.mode("errorifexists").parquet(backup)
        before = self.spark.read.schema(SCHEMA).parquet(backup).select(*columns)
        kept = change(before).select(*columns)
        number, left = before.count(), kept.count()
        if left:
            self._replace(kept, snapshot)
        else:
            self.drop(kb_id)
        return {"original": number, "kept": left, "rejected": number - left}

    def backfill(self, kb_id: int, found: DataFrame, on: list[str], snapshot: str, columns: tuple[str, ...] = ("department", "publish_year")) -> int:
        """Fills blank columns of a collection's chunks from found (`on` and those columns); the number of chunks that changed. What is there stays; of
        several values found for a chunk the greatest that isn't blank counts."""
        rows = self.read(kb_id)
        new = found.groupBy(*on).agg(*[F.max(F.when(F.col(c) != "", F.col(c))).alias(f"__{c}") for c in columns])
        blank = {c: F.coalesce(F.col(c), F.lit("")) == "" for c in columns}
        met = rows.join(new, on, "left")
        gains = reduce(Column.__or__, [blank[c] & (F.coalesce(F.col(f"__{c}"), F.lit("")) != "") for c in columns])
        changed = met.where(gains).count()
        if changed:
            filled = met.withColumns({c: F.when(blank[c], F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in columns})
            self._replace(filled.select(*rows.columns), snapshot)
        return changed

    def drop(self, kb_id: int) -> None:
        """Removes a collection's folder; one that isn't there is no error."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/kb_id={kb_id}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
