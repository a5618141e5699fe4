"""A property graph as a table of edges: kb_id, src, rel, dst, chunk_ids, document_id."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.operators.texts import containing


def merged(triples: DataFrame) -> DataFrame:
    """Edges from extracted triples (kb_id, src, rel, dst, chunk_id, document_id): one of each, with its chunks in order and its first
    document. Triples without an end or a relation don't count."""
    usable = triples.where("src IS NOT NULL AND dst IS NOT NULL AND rel IS NOT NULL AND src <> '' AND dst <> '' AND rel <> ''")
    return usable.groupBy("kb_id", "src", "rel", "dst").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.min("document_id").alias("document_id"))


def without_document(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges that none of these documents (document_id) has made."""
    return edges.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def around(edges: DataFrame, asked: DataFrame, hops: int = 2, per_entity: int = 30, limit: int = 30, scoped: bool = True) -> DataFrame:
    """query_id, src, rel, dst, place: edges on paths of up to `hops` edges that begin or end at a node whose name contains an entity.

    asked: query_id, entity (and kb_id where scoped). Names meet entities by an index (see texts.containing); paths grow from
    matching nodes only, forward and backward, by one equality join for each hop. Edges are ordered by name; an entity gives `per_entity` of them, a query `limit`.
    """
    scope = ["kb_id"] if scoped else []
    own = edges.select(*scope, "src", "rel", "dst").distinct()
    nodes = own.select(*scope, F.col("src").alias("node")).union(own.select(*scope, "dst")).distinct()
    start = containing(nodes, "node", asked.select("query_id", "entity", *scope).distinct(), "entity", tuple(scope))
    who = ["query_id", "entity", *scope]
    found = []
    for here, there in (("src", "dst"), ("dst", "src")):
        front = start.select(*who, "node").distinct()
        for _ in range(hops):
            step = front.join(own.withColumnRenamed(here, "node"), [*scope, "node"]).withColumnRenamed("node", here)
            found.append(step.select("query_id", "entity", "src", "rel", "dst"))
            front = step.select(*who, F.col(there).alias("node")).distinct()
    edges_of = reduce(DataFrame.union, found).distinct()
    by_entity = Window.partitionBy("query_id", "entity").orderBy("src", "rel", "dst")
    kept = edges_of.withColumn("n", F.row_number().over(by_entity)).where(F.col("n") <= per_entity).select("query_id", "src", "rel", "dst").distinct()
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("src", "rel", "dst"))).where(F.col("place") <= limit)


def formatted(triples: DataFrame, text: str = "{src} -[{rel}]-> {dst}") -> DataFrame:
    """query_id, context: a query's triples as lines, in order of their place."""
    line = F.lit(text)
    for name in ("src", "rel", "dst"):
        line = F.replace(line, F.lit("{" + name + "}"), F.col(name))
    lines = triples.select("query_id", "place", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    return lines.select("query_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("context"))
