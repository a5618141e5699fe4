"""A query's rows against DuckDB's for its SQL, as the same set of values by column name."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def shown(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{float(value):.9g}"


def rows(frame: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(shown, r)) for r in frame.astype(object).itertuples(index=False, name=None))
