"""Retrieval, text and relational analytics over document collections as Spark jobs."""
