"""Collections behind one interface, with two back ends.

`Collections` (a folder a collection) and `CommittedStore` (immutable files under commits) offer the same methods, so that what is written for one runs on the
other; `store` picks one by name. The second is a Spark data source of its own, format `chunk_store`:

    spark.dataSource.register(ChunkStore)
    spark.read.format("chunk_store").load(path).where("kb_id = 3")      # reads the files of collection 3 only
    rows.write.format("chunk_store").option("replace", "3,5").mode("append").save(path)

A write's files become visible all at once, by a commit: a small file that lists the live files. A failed write leaves no trace, two writes at a time
can't both become the next commit, and a reader keeps the commit that it began with.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from corvine.sources.collections import SCHEMA, Collections

_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Store(ABC):
    """What a store of collections of chunks does (see collections.SCHEMA for a chunk's columns)."""

    @abstractmethod
    def read(self, *kb_ids: int) -> DataFrame:
        """All chunks, or those of some collections."""

    @abstractmethod
    def append(self, rows: DataFrame) -> None:
        """Adds chunks; columns that rows doesn't have are null."""

    @abstractmethod
    def upsert(self, rows: DataFrame) -> None:
        """Chunks of rows take the place of those with their collection and id."""

    @abstractmethod
    def delete(self, kb_id: int, removed: DataFrame, on: list[str]) -> None:
        """Takes out a collection's chunks that match removed on the columns `on`."""

    @abstractmethod
    def drop(self, kb_id: int) -> None:
        """Removes a collection; one that isn't there is no error."""


Store.register(Collections)


def store(spark: SparkSession, path: str, kind: str = "folders") -> Store:
    """The store at a path: `folders` or `committed`."""
    if kind == "folders":
        return Collections(spark, path)
    if kind == "committed":
        return CommittedStore(spark, path)
    raise ValueError(f"unknown store {kind}")


# ---- the data source

def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _commits(system: fs.FileSystem, root: str) -> list[int]:
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(int(posixpath.basename(f.path).removesuffix(".json")) for f in found if f.path.endswith(".json"))


def _live(path: str) -> tuple[int, list[dict]]:
    """The number of the last commit (-1: none) and the files that it lists: name, kb_id, rows."""
    system, root = _opened(path)
    numbers = _commits(system, root)
    if not numbers:
        return -1, []
    with system.open_input_stream(f"{root}/commits/{numbers[-1]}.json") as file:
        return numbers[-1], json.loads(file.read())


@dataclass
class _Part(InputPartition):
    name: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes over what asks for collections; Spark does the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("kb_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Part(f["name"]) for f in _live(self.path)[1] if self.wanted is None or f["kb_id"] in self.wanted] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.name:
            system, root = _opened(self.path)
            with system.open_input_file(f"{root}/files/{partition.name}") as file:
                yield from pq.ParquetFile(file).iter_batches(4096)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, replace: set[int]) -> None:
        self.path, self.overwrite, self.replace = path, overwrite, replace
        self.base = _live(path)[0]  # what this write has seen

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """A file for each collection that the task has rows of."""
        system, root = _opened(self.path)
        system.create_dir(f"{root}/files", recursive=True)
        open_files: dict[int | None, tuple[pq.ParquetWriter, dict]] = {}
        try:
            for batch in iterator:
                for kb in pc.unique(batch.column("kb_id")).to_pylist():
                    own = batch.filter(pc.is_null(batch.column("kb_id")) if kb is None else pc.equal(batch.column("kb_id"), kb))
                    if kb not in open_files:
                        name = f"{uuid.uuid4().hex}.parquet"
                        open_files[kb] = (pq.ParquetWriter(f"{root}/files/{name}", batch.schema, filesystem=system), {"name": name, "kb_id": kb, "rows": 0})
                    writer, entry = open_files[kb]
                    writer.write_batch(own)
                    entry["rows"] += own.num_rows
        finally:
            for writer, _ in open_files.values():
                writer.close()
        return _Written([entry for _, entry in open_files.values()])

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _opened(self.path)
        number, before = _live(self.path)
        if number != self.base:
            self.abort(messages)
            raise RuntimeError(f"commit {number} came in between; read again and repeat the write")
        kept = [] if self.overwrite else [f for f in before if f["kb_id"] not in self.replace]
        content = json.dumps([*kept, *(f for m in messages if m for f in m.files)]).encode()
        system.create_dir(f"{root}/commits", recursive=True)
        name = f"{root}/commits/{number + 1}.json"
        if isinstance(system, fs.LocalFileSystem):
            with open(name, "xb") as file:  # fails if another write was first
                file.write(content)
        else:
            with system.open_output_stream(draft := f"{root}/commits/{uuid.uuid4().hex}") as file:
                file.write(content)
            if system.get_file_info(name).type != fs.FileType.NotFound:
                raise RuntimeError("another write was first; read again and repeat the write")
            system.move(draft, name)

    def abort(self, messages: list[_Written | None]) -> None:
        """Files of a write that doesn't become a commit go."""
        system, root = _opened(self.path)
        for message in messages:
            for f in message.files if message else []:
                system.delete_file(f"{root}/files/{f['name']}")


class ChunkStore(DataSource):
    """Format chunk_store: path; option replace: collections (ids, separated by commas) whose earlier files the write takes the place of."""

    @classmethod
    def name(cls) -> str:
        return "chunk_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, {int(k) for k in self.options.get("replace", "").split(",") if k})


class CommittedStore(Store):
    """Collections in immutable files under commits; each change is one commit. Switches the pushdown of filters to Python data sources on in the session."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.dataSource.register(ChunkStore)
        spark.conf.set(_PUSHDOWN, "true")

    def read(self, *kb_ids: int) -> DataFrame:
        rows = self.spark.read.format("chunk_store").load(self.path)
        return rows.where(F.col("kb_id").isin(list(kb_ids))) if kb_ids else rows

    def _save(self, rows: DataFrame, replace: list[int] = ()) -> None:
        fields = self.spark.createDataFrame([], SCHEMA).schema
        all_columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        rows.select(*all_columns).write.format("chunk_store").option("replace", ",".join(map(str, replace))).mode("append").save(self.path)

    def append(self, rows: DataFrame) -> None:
        self._save(rows)

    def upsert(self, rows: DataFrame) -> None:
        touched = [r[0] for r in rows.select("kb_id").distinct().collect()]
        kept = self.read(*touched).join(rows.select("kb_id", "chunk_id"), ["kb_id", "chunk_id"], "left_anti")
        self._save(kept.unionByName(rows, allowMissingColumns=True), touched)

    def delete(self, kb_id: int, removed: DataFrame, on: list[str]) -> None:
        self._save(self.read(kb_id).join(removed.select(*on).distinct(), on, "left_anti"), [kb_id])

    def drop(self, kb_id: int) -> None:
        self._save(self.read(kb_id).where("false"), [kb_id])

    def commits(self) -> int:
        """How many changes there were."""
        return _live(self.path)[0] + 1

    def vacuum(self) -> int:
        """Removes the files that the last commit doesn't list, and the commits before it; the number of files. No reader of an older commit may be at work."""
        system, root = _opened(self.path)
        number, live = _live(self.path)
        names = {f["name"] for f in live}
        gone = [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/files", allow_not_found=True)) if posixpath.basename(f.path) not in names]
        for path in [*gone, *(f"{root}/commits/{n}.json" for n in _commits(system, root) if n < number)]:
            system.delete_file(path)
        return len(gone)
