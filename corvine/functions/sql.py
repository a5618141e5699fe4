"""Table functions for SQL: `SELECT doc_id, c.* FROM documents, LATERAL chunk(text, 'fixed', 800, 150) AS c`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corvine.operators.chunks import STRATEGIES

_SIZED = {"fixed", "sentence"}


class Chunks:
    """chunk_index (from 0), content, total_chunks of a text's chunks; none for null and blank texts.

    chunk(text, strategy => 'fixed', size => 800, overlap => 150): strategy fixed, sentence, markdown or semantic; overlap holds for the
    first two. The options are constants and are checked before the query runs.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("chunk: text must be a string")
        for name, given in (("strategy", strategy), ("size", size), ("overlap", overlap)):
            if given is not None and not given.isConstantExpression:
                raise ValueError(f"chunk: {name} must be a constant")
        chosen = "fixed" if strategy is None else strategy.value
        if chosen not in STRATEGIES:
            raise ValueError(f"chunk: unknown strategy {chosen}; known are {', '.join(STRATEGIES)}")
        if overlap is not None and chosen not in _SIZED:
            raise ValueError(f"chunk: {chosen} has no overlap")
        length = 800 if size is None else size.value
        if not isinstance(length, int) or length < 1:
            raise ValueError("chunk: size must be a positive whole number")
        if overlap is not None and (not isinstance(overlap.value, int) or not 0 <= overlap.value < length):
            raise ValueError("chunk: overlap must be a whole number from 0 to below size")
        return AnalyzeResult(StructType().add("chunk_index", IntegerType()).add("content", StringType()).add("total_chunks", IntegerType()))

    def eval(self, text: str | None, strategy: str = "fixed", size: int = 800, overlap: int | None = None) -> Iterator[tuple]:
        if text is None or not text.strip():
            return
        options = {"size": size} if overlap is None else {"size": size, "overlap": overlap}
        found = list(STRATEGIES[strategy](text, **options))
        for index, content in enumerate(found):
            yield index, content, len(found)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session."""
    spark.udtf.register("chunk", udtf(Chunks, useArrow=True))
