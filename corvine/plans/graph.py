"""Queries of the graph operators over edges supplier → nation → region and customer → nation."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.operators import graph as g
from corvine.operators.registry import query

EDGES = """edges AS (SELECT 'a' AS kb_id, s_name AS src, 'based in' AS rel, n_name AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'a', n_name, 'part of', r_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'b', c_name, 'lives in', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
ASKED = [(1, "AFRICA", "a"), (2, "NATION_3", "b"), (3, "EUROPE", "a"), (3, "Supplier#00", "a"), (4, "no such name", "a")]
_ASKED = "asked(query_id, entity, kb_id) AS (VALUES " + ", ".join(f"({q}, '{e}', '{k}')" for q, e, k in ASKED) + ")"


def edges(t):
    based = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.lit("a").alias("kb_id"), F.col("s_name").alias("src"), F.lit("based in").alias("rel"), F.col("n_name").alias("dst"))
    within = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("a"), "n_name", F.lit("part of"), "r_name")
    lives = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.lit("b"), "c_name", F.lit("lives in"), "n_name")
    return reduce(DataFrame.union, [based, within, lives])


def asked(t):
    return t.spark.createDataFrame(ASKED, "query_id int, entity string, kb_id string")


def _around_sql(scoped):
    kb = (lambda x: f"AND {x}.kb_id = q.kb_id") if scoped else (lambda x: "")
    pair = "AND x.kb_id = y.kb_id" if scoped else ""
    return f"""{EDGES}, {_ASKED}, paths AS (
      SELECT query_id, entity, x.src, x.rel, x.dst FROM edges x JOIN asked q ON (contains(x.src, entity) OR contains(x.dst, entity)) {kb('x')}
      UNION SELECT query_id, entity, x.src, x.rel, x.dst FROM edges x JOIN edges y ON x.dst = y.src {pair} JOIN asked q ON (contains(x.src, entity) OR contains(y.dst, entity)) {kb('x')}
      UNION SELECT query_id, entity, y.src, y.rel, y.dst FROM edges x JOIN edges y ON x.dst = y.src {pair} JOIN asked q ON (contains(x.src, entity) OR contains(y.dst, entity)) {kb('x')}),
    kept AS (SELECT DISTINCT query_id, src, rel, dst FROM (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY query_id, entity ORDER BY src, rel, dst) <= 30)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, rel, dst) AS place FROM kept QUALIFY place <= 30)"""


@query(f"WITH {_around_sql(True)} SELECT query_id, place, src, rel, dst FROM placed")
def khop_subgraph(t):
    return g.around(edges(t), asked(t)).select("query_id", "place", "src", "rel", "dst")


@query(f"WITH {_around_sql(False)} SELECT query_id, place, src, rel, dst FROM placed")
def khop_global(t):
    return g.around(edges(t), asked(t), scoped=False).select("query_id", "place", "src", "rel", "dst")


@query(f"WITH {_around_sql(True)} SELECT query_id, string_agg(src || ' -[' || rel || ']-> ' || dst, chr(10) ORDER BY place) AS context FROM placed GROUP BY query_id")
def triples_format(t):
    return g.formatted(g.around(edges(t), asked(t)))


@query("""SELECT event_type AS src, 'seen by' AS rel, user_id::VARCHAR AS dst, array_to_string(list_sort(list(DISTINCT (event_id % 50)::VARCHAR)), ',') AS chunks, min(event_id) AS document_id FROM events GROUP BY event_type, user_id""")
def graph_upsert(t):
    triples = t("events").select(F.lit("k").alias("kb_id"), F.col("event_type").alias("src"), F.lit("seen by").alias("rel"), F.col("user_id").cast("string").alias("dst"), (F.col("event_id") % 50).cast("string").alias("chunk_id"), F.col("event_id").alias("document_id"))
    return g.merged(triples).select("src", "rel", "dst", F.array_join("chunk_ids", ",").alias("chunks"), "document_id")
