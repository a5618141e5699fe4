"""Queries of the context operators."""

from pyspark.sql import functions as F

from corvine.operators import context as c
from corvine.operators import retrieval as r
from corvine.operators.registry import query
from corvine.plans.retrieval import BM25, COSINES, TOP, cosines, questions, vector_questions


@query(f"""WITH {BM25}, ranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM bm25 QUALIFY place <= 5),
    rows AS (SELECT query_id, place, trim(text) AS content, '[来源' || place || ']' AS label, source, '[来源' || place || ']（' || source || '）' AS head FROM ranked JOIN documents USING (doc_id)),
    sized AS (SELECT *, 2000 - coalesce(sum((length(head) + 1 + length(content)) // 2 + 5) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - length(head) // 2 - 5 AS left_over FROM rows),
    marked AS (SELECT *, length(content) // 2 <= left_over AS fits FROM sized), going AS (SELECT *, coalesce(bool_or(NOT fits) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM marked),
    blocks AS (SELECT query_id, place, label, source, head || chr(10) || CASE WHEN fits THEN content ELSE rtrim(content[1 : greatest(40, floor(length(content) * left_over / (length(content) // 2)))::INTEGER]) END AS block FROM going WHERE NOT over AND left_over > 40)
    SELECT *, length(block) // 2 AS n_tokens FROM blocks""")
def context_budget_pack(t):
    ranked = r.best(r.bm25(t("documents"), questions(t), "doc_id", 5), 5, key="doc_id", rank="place")
    return c.pack(ranked.join(t("documents").select("doc_id", "source", F.col("text").alias("content")), "doc_id"))


ANSWER = "'See [来源' || (event_id % 7 + 2) || '] and [来源' || (event_id % 5 + 1) || '], not [来源' || (event_id % 7 + 2) || '].'"


@query(f"""SELECT event_id AS query_id, 'See [来源' || (1 + (b < a)::INTEGER) || '] and [来源' || (1 + (a < b)::INTEGER) || '], not [来源' || (1 + (b < a)::INTEGER) || '].' AS answer FROM (SELECT event_id, event_id % 7 + 2 AS a, event_id % 5 + 1 AS b FROM events)""")
def citation_renumber(t):
    return t("events").select(F.col("event_id").alias("query_id"), c.renumbered(F.expr(ANSWER)).alias("answer"))


@query("""WITH s AS (SELECT event_id AS query_id, n::INTEGER AS n, n = event_id % 7 + 2 OR n = event_id % 5 + 1 AS used FROM events, range(1, 6) r(n)) SELECT query_id, n, row_number() OVER (PARTITION BY query_id ORDER BY used DESC, n) AS new_n FROM s""")
def citation_order(t):
    sources = t("events").select(F.col("event_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))
    return c.cite_order(sources, t("events").select(F.col("event_id").alias("query_id"), F.expr(ANSWER).alias("answer")))


@query("""WITH r AS (SELECT conv_id, turn, role, text, length(coalesce(text, '')) // 2 AS t, row_number() OVER w AS n, sum(length(coalesce(text, '')) // 2) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
    o AS (SELECT conv_id, sum(t) AS total, count(*) AS number, sum(t) FILTER (n <= 3) AS near, count(*) FILTER (n <= 3 AND s <= 600) AS fit FROM r GROUP BY conv_id),
    p AS (SELECT *, CASE WHEN total <= 600 THEN number WHEN near >= 600 THEN CASE WHEN fit > 0 THEN fit ELSE 2 END ELSE least(3, number) END AS keep, total > 600 AND near < 600 AND number > 3 AS stub FROM o)
    SELECT conv_id, turn, role, text FROM r JOIN p USING (conv_id) WHERE n <= keep UNION ALL SELECT conv_id, -1, 'system', '[历史摘要] 之前进行了 ' || (number - 3) || ' 轮对话。' FROM p WHERE stub""")
def memory_window(t):
    return c.memory(t("conversations"), budget=600, recent=3)


@query(f"""WITH {COSINES}, first AS (SELECT query_id, vec_id % 40 AS content, score FROM cosines WHERE label = CASE WHEN query_id % 2 = 0 THEN query_id ELSE (query_id + 1) % 10 END QUALIFY {TOP.format('vec_id', 3)}), second AS (SELECT query_id, vec_id % 40 AS content, score FROM cosines QUALIFY {TOP.format('vec_id', 5)}),
    good AS (SELECT query_id FROM first GROUP BY query_id HAVING max(score) >= 0.6), rows AS (SELECT *, 1 AS round FROM first UNION ALL SELECT *, 2 FROM second WHERE query_id NOT IN (SELECT query_id FROM good)),
    once AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY round, score DESC) = 1)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round, score DESC, content) AS place, content, score AS similarity, round FROM once""")
def crag_two_round(t):
    """The first round looks into the collection that a question names, for half of them the wrong one; the second into all."""
    named = F.when(F.col("query_id") % 2 == 0, F.col("query_id")).otherwise((F.col("query_id") + 1) % 10)
    one = r.cosine_topk(t("embeddings"), vector_questions(t).withColumn("label", named), "vec_id", 3, within=["label"])
    shown = lambda rows: rows.select("query_id", (F.col("vec_id") % 40).alias("content"), F.col("score").alias("similarity"))
    return c.corrective(shown(one), shown(cosines(t, 5)), least=0.6)


@query("""WITH claims AS (SELECT item_id AS answer_id, unnest([text[1:40], text[41:80], 'never said']) AS claim FROM benchmark), j AS (SELECT answer_id, contains(lower(text), lower(claim)) AS ok FROM claims JOIN benchmark ON item_id = answer_id)
    SELECT answer_id, count(*) AS n_claims, count(*) FILTER (ok) AS n_supported, 0::BIGINT AS n_unknown, round(avg(ok::INTEGER), 4) AS grounded_ratio FROM j GROUP BY answer_id""")
def grounding_ratio(t):
    claims = t("benchmark").select(F.col("item_id").alias("answer_id"), F.explode(F.array(F.substring("text", 1, 40), F.substring("text", 41, 40), F.lit("never said"))).alias("claim"))
    return c.grounding(claims, t("benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("content")))
