"""All queries of the library with DuckDB SQL for the same rows.

A module of operators registers the queries that apply them to the tables of a data folder:

    @query("SELECT ...")
    def name(t): return some_operator(t("orders"))

`t` reads a table by its name. Without SQL the query is one that SQL can't express.
"""

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from corvine.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """Reads the tables of a folder."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def stream(self, name: str) -> DataFrame:
        """The table as a stream of its files. (The path is a pattern: a stream of a plain path must be a folder's.)"""
        return self.spark.readStream.schema(self(name).schema).parquet(f"{self.folder}/{name}.parque[t]")


def query(sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder))

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def load() -> None:
    """Imports the modules that register queries."""
    for module in ("relational", "text", "retrieval", "chunks", "evaluation", "access", "graph", "context", "streams", "assistant"):
        import_module(f"corvine.plans.{module}")
