"""Queries: operators applied to the tables of a data folder, with DuckDB SQL for their rows."""
