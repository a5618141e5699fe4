"""Queries of the retrieval operators. The benchmark's items are the questions, documents are the texts; for vectors the
questions are the first vector of each label, and a vector's collection is vec_id modulo 7."""

from pyspark.sql import functions as F

from corvine.functions import text as f
from corvine.functions import vectors as v
from corvine.operators import chunks, hooks
from corvine.operators import retrieval as r
from corvine.operators.registry import query
from corvine.sources.tables import spread

STOP = ", ".join(f"'{w}'" for w in f.STOPWORDS)
WORDS = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (" + STOP.replace("{", "{{") + "))"

#: BM25L scores of all documents for the benchmark's items.
BM25 = f"""docs AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
    corpus AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM docs),
    asked AS (SELECT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark), terms AS (SELECT query_id, term, count(*) AS qtf FROM asked GROUP BY ALL),
    held AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM docs), tfs AS (SELECT doc_id, len, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
    parts AS (SELECT query_id, doc_id, qtf * ln((n_docs + 1) / (df + 0.5)) * 2.5::DOUBLE AS w, tf / (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len) AS c FROM tfs JOIN terms USING (term) JOIN dfs USING (term), corpus),
    bm25 AS (SELECT query_id, doc_id, round(sum(w * (c + 0.5::DOUBLE) / (1.5::DOUBLE + c + 0.5::DOUBLE)), 6) AS score FROM parts GROUP BY ALL HAVING score > 0)"""

#: Cosines of all vectors with the first vector of each label.
COSINES = """firsts AS (SELECT label AS query_id, min(vec_id) AS q FROM embeddings GROUP BY label), questions AS (SELECT query_id, embedding::DOUBLE[] AS qv FROM firsts JOIN embeddings ON vec_id = q),
    cosines AS (SELECT query_id, vec_id, vec_id % 7 AS kb_id, label, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 6) AS score FROM embeddings, questions)"""


def questions(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_questions(t):
    firsts = t("embeddings").groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("x"))
    return firsts.select(F.col("label").alias("query_id"), F.col("x.embedding").alias("embedding"))


def cosines(t, k):
    return r.cosine_topk(t("embeddings"), vector_questions(t), "vec_id", k)


TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {}) <= {}"


@query(f"WITH {BM25} SELECT query_id, doc_id, score FROM bm25 QUALIFY {TOP.format('doc_id', 10)}")
def bm25_topk(t):
    return r.bm25(t("documents"), questions(t), "doc_id", 10)


@query(f"""WITH docs AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), asked AS (SELECT item_id AS query_id, {WORDS.format('text')} AS q FROM benchmark WHERE len({WORDS.format('text')}) > 0),
    terms AS (SELECT DISTINCT query_id, unnest(q) AS term FROM asked), words AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM docs),
    held AS (SELECT query_id, doc_id, count(*) AS n FROM words JOIN terms USING (term) GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, round(n / len(list_distinct(q)) + CASE WHEN n = len(list_distinct(q)) THEN 3.0 ELSE 0.0 END
      + CASE WHEN n = len(list_distinct(q)) AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') THEN 5.0 ELSE 0.0 END, 6) AS score FROM held JOIN asked USING (query_id) JOIN docs USING (doc_id))
    SELECT query_id, doc_id, score::DOUBLE AS score FROM scored QUALIFY {TOP.format('doc_id', 10)}""")
def boolean_phrase_score(t):
    return r.boolean_phrase(t("documents"), questions(t), "doc_id", 10)


@query(f"WITH {COSINES} SELECT query_id, vec_id, score FROM cosines QUALIFY {TOP.format('vec_id', 20)}")
def cosine_topk(t):
    return cosines(t, 20)


@query(f"""WITH {COSINES}, near AS (SELECT * FROM cosines QUALIFY {TOP.format('vec_id', 20)})
    SELECT query_id, vec_id, round(greatest(0, least(1, 1 - (1 - score))), 6) AS by_cosine, round(1 / (1 + greatest(0, 1 - score)), 6) AS by_product FROM near""")
def distance_to_similarity(t):
    distance = 1 - F.col("score")
    return cosines(t, 20).select("query_id", "vec_id", F.round(v.similarity_of_distance(distance), 6).alias("by_cosine"), F.round(v.similarity_of_distance(distance, "ip"), 6).alias("by_product"))


@query(f"""WITH {COSINES}, near AS (SELECT * FROM cosines QUALIFY {TOP.format('vec_id', 10)}),
    counted AS (SELECT *, count(*) FILTER (score >= 0.5) OVER (PARTITION BY query_id) AS passing, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM near)
    SELECT query_id, vec_id, score FROM counted WHERE CASE WHEN passing < 3 THEN n <= 3 ELSE score >= 0.5 END""")
def threshold_backfill(t):
    """A collection's threshold; three results where fewer pass."""
    return r.passing_or_first(cosines(t, 10), F.col("score") >= 0.5, 10, F.desc("score"), F.asc("vec_id"), least=3)


@query(f"""WITH {COSINES}, strict AS (SELECT * FROM cosines WHERE label = query_id AND vec_id % 50 = query_id QUALIFY {TOP.format('vec_id', 5)}),
    partly AS (SELECT * FROM cosines WHERE label = query_id AND query_id < 7 QUALIFY {TOP.format('vec_id', 5)}), free AS (SELECT * FROM cosines QUALIFY {TOP.format('vec_id', 5)}),
    ns AS (SELECT query_id, (SELECT count(*) FROM strict s WHERE s.query_id = f.query_id) AS n1, (SELECT count(*) FROM partly s WHERE s.query_id = f.query_id) AS n2 FROM firsts f),
    chosen AS (SELECT query_id, CASE WHEN n1 < 2 AND n2 > n1 THEN 2 WHEN n1 > 0 THEN 1 ELSE 3 END AS tier FROM ns)
    SELECT query_id, tier, vec_id, score FROM chosen JOIN (SELECT *, 1 AS tier FROM strict UNION ALL SELECT *, 2 FROM partly UNION ALL SELECT *, 3 FROM free) USING (query_id, tier)""")
def filter_relaxation(t):
    """Tiers of filters; the queries' own cosines are computed once per tier over what its filter leaves."""
    asked = vector_questions(t).withColumn("label", F.col("query_id"))
    rows = t("embeddings").withColumn("rest", F.col("vec_id") % 50)
    strict = r.cosine_topk(rows, asked.withColumn("rest", F.col("query_id").cast("long")), "vec_id", 5, within=["label", "rest"])
    some = r.cosine_topk(rows, asked.where("query_id < 7"), "vec_id", 5, within=["label"])
    return r.relax([strict, some, r.cosine_topk(rows, asked, "vec_id", 5)]).select("query_id", "tier", "vec_id", "score")


def pools(t, size):
    """A question's lexical results among documents, and as vector results the documents whose vectors are near that of the
    document of its own number."""
    lexical = r.bm25(t("documents"), questions(t), "doc_id", size)
    asked = t("embeddings").join(questions(t).select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")
    own = t("embeddings").join(t("documents").select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi").withColumnRenamed("vec_id", "doc_id")
    return lexical, r.cosine_topk(own, asked, "doc_id", size)


def hybrid(t, n=10, alpha=0.7):
    return r.fuse(*pools(t, 2 * n), "doc_id", n, alpha)


def fused_sql(n=10, alpha=0.7):
    return f"""lexical AS (SELECT query_id, doc_id, 1 / (1 + exp(-score / 10)) AS bm25_score, score FROM bm25 QUALIFY {TOP.format('doc_id', 2 * n)}),
    semantic AS (SELECT q.item_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id, embeddings d WHERE d.vec_id IN (SELECT doc_id FROM documents) QUALIFY {TOP.format('doc_id', 2 * n)}),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rv, count(*) OVER (PARTITION BY query_id) AS nv FROM semantic),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) - 1 AS rb, count(*) OVER (PARTITION BY query_id) AS nb FROM lexical),
    met AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.score AS vs, bm25_score AS bs, rv, rb, nv, nb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
    far AS (SELECT *, greatest(coalesce(max(nv) OVER w, 0), coalesce(max(nb) OVER w, 0), {n}) AS behind FROM met WINDOW w AS (PARTITION BY query_id)),
    scored AS (SELECT query_id, doc_id, round({alpha}::DOUBLE / (60 + coalesce(rv, behind)) + (1 - {alpha}::DOUBLE) / (60 + coalesce(rb, behind)), 9) AS score, round({alpha}::DOUBLE * coalesce(vs, 0) + (1 - {alpha}::DOUBLE) * coalesce(bs, 0), 9) AS similarity,
      coalesce(vs, 0) AS vector_score, round(coalesce(bs, 0), 6) AS bm25_score FROM far),
    gated AS (SELECT *, bm25_score > 0.5 OR vector_score >= 0.35 AS ok FROM scored), numbered AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY query_id) AS passing, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n_all, row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, score DESC, doc_id) AS n FROM gated),
    fused AS (SELECT query_id, doc_id, score, similarity, vector_score, bm25_score FROM numbered WHERE CASE WHEN passing < 1 THEN n_all <= 1 ELSE ok AND n <= {n} END)"""


@query(f"WITH {BM25}, {fused_sql()} SELECT * FROM fused")
def hybrid_rrf_topk(t):
    return hybrid(t)


@query(f"WITH {BM25}, {fused_sql(5, 0.5)} SELECT query_id, doc_id, score FROM fused")
def rrf_fusion(t):
    return hybrid(t, 5, 0.5).select("query_id", "doc_id", "score")


@query(f"""WITH {COSINES}, near AS (SELECT * FROM cosines QUALIFY {TOP.format('vec_id', 30)}),
    factors AS (SELECT query_id, vec_id, score, CASE WHEN label = query_id THEN 1.3::DOUBLE ELSE 1.0 END * CASE WHEN vec_id % 4 = 0 THEN 1.15::DOUBLE ELSE 1.0 END AS f FROM near)
    SELECT query_id, vec_id, round(score * f, 10) AS score, round(least(1, score * f), 10) AS similarity FROM factors""")
def constraint_boost(t):
    near = cosines(t, 30).join(t("embeddings").select("vec_id", "label"), "vec_id").withColumn("similarity", F.col("score"))
    return r.boost(near, F.col("label") == F.col("query_id"), F.col("vec_id") % 4 == 0).select("query_id", "vec_id", "score", "similarity")


@query(f"""WITH {COSINES}, centres AS (SELECT kb_id, list(avg ORDER BY i) AS c FROM (SELECT kb_id, i, round(avg(embedding[i + 1]::DOUBLE), 9) AS avg FROM (SELECT vec_id % 7 AS kb_id, embedding, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL) GROUP BY kb_id),
    scored AS (SELECT query_id, kb_id, kb_id = 2 AS pinned, round(list_cosine_similarity(qv, c), 6) AS score FROM questions, centres)
    SELECT query_id, kb_id, pinned, score FROM scored QUALIFY pinned OR row_number() OVER (PARTITION BY query_id, pinned ORDER BY score DESC, kb_id) <= 2""")
def kb_routing(t):
    long = t("embeddings").select((F.col("vec_id") % 7).alias("kb_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    centres = long.groupBy("kb_id", "i").agg(F.round(F.avg("x"), 9).alias("x")).groupBy("kb_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    collections = centres.select("kb_id", (F.col("kb_id") == 2).alias("pinned"), F.col("c.x").alias("embedding"))
    return r.route(collections, vector_questions(t), 3)


@query(f"""WITH {COSINES}, layers AS (SELECT query_id, CASE WHEN kb_id < 3 THEN 0 ELSE 1 END AS layer, kb_id, vec_id, score FROM cosines QUALIFY row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, vec_id) <= 4)
    SELECT query_id, kb_id, vec_id AS chunk_id, score AS similarity, row_number() OVER w AS place, count(*) OVER (PARTITION BY query_id) AS total_found FROM layers WINDOW w AS (PARTITION BY query_id ORDER BY greatest(score, 0) DESC, kb_id, vec_id) QUALIFY place <= 5""")
def layered_merge_top5(t):
    """Layers of collections; the second layer finds the first's results again, which count once."""
    rows = t("embeddings").withColumn("kb_id", F.col("vec_id") % 7)
    kbs = t("embeddings").select((F.col("vec_id") % 7).alias("kb_id")).distinct()
    near = r.cosine_topk(rows, vector_questions(t).crossJoin(kbs).select(F.struct("query_id", "kb_id").alias("query_id"), "kb_id", "embedding"), "vec_id", 4, within=["kb_id"])
    found = near.select("query_id.*", F.col("vec_id").alias("chunk_id"), F.col("score").alias("similarity"), F.lit(None).cast("double").alias("final_score"), F.col("vec_id").cast("string").alias("content"))
    layers = found.where("kb_id < 3").withColumn("layer", F.lit(0)).unionByName(found.withColumn("layer", F.lit(1)))
    return r.merge_layers(layers).select("query_id", "kb_id", "chunk_id", "similarity", "place", "total_found")


@query(f"""WITH {BM25}, results AS (SELECT query_id // 2 AS query_id, query_id % 2 AS rewrite, doc_id, score FROM bm25 QUALIFY {TOP.format('doc_id', 10)})
    SELECT query_id, rewrite, doc_id, score FROM (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rewrite) = 1) QUALIFY {TOP.format('doc_id', 10)}""")
def multi_query_union(t):
    """Two items of the benchmark are the rewrites of one question."""
    found = r.bm25(t("documents"), questions(t), "doc_id", 10).select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("rewrite"), "doc_id", "score")
    return r.union_of_rewrites(found, "doc_id", 10)


@query(f"""WITH RECURSIVE {BM25}, pool AS (SELECT query_id, doc_id, 1 / (1 + exp(-score / 10)) AS score, text FROM (SELECT * FROM bm25 QUALIFY {TOP.format('doc_id', 20)}) JOIN documents USING (doc_id)),
    grams AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: text[i:i + 2]))) AS g FROM (SELECT doc_id, any_value(text) AS text FROM pool GROUP BY doc_id)), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.text = b.text AS same FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.doc_id <> b.doc_id),
    common AS (SELECT p.a, p.b, count(*) AS c FROM pairs p JOIN grams x ON x.doc_id = p.a JOIN grams y ON y.doc_id = p.b AND y.g = x.g GROUP BY ALL),
    sims AS (SELECT p.a, p.b, CASE WHEN x.n IS NULL OR y.n IS NULL THEN same::INTEGER::DOUBLE ELSE coalesce(c, 0)::DOUBLE / (x.n + y.n - coalesce(c, 0)) END AS s FROM pairs p LEFT JOIN common USING (a, b) LEFT JOIN sizes x ON x.doc_id = p.a LEFT JOIN sizes y ON y.doc_id = p.b),
    picked AS (SELECT query_id, [list(doc_id ORDER BY score DESC, doc_id)[1]] AS chosen FROM pool GROUP BY query_id
      UNION ALL SELECT query_id, list_append(chosen, list(doc_id ORDER BY round(0.7::DOUBLE * score - 0.3::DOUBLE * near, 12) DESC, score DESC, doc_id)[1])
      FROM (SELECT k.query_id, k.chosen, p.doc_id, p.score, max(s.s) AS near FROM picked k JOIN pool p ON p.query_id = k.query_id AND NOT list_contains(k.chosen, p.doc_id) JOIN sims s ON s.a = p.doc_id AND list_contains(k.chosen, s.b) WHERE len(k.chosen) < 10 GROUP BY ALL) GROUP BY query_id, chosen),
    best AS (SELECT query_id, chosen FROM picked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(chosen) DESC) = 1)
    SELECT query_id, unnest(chosen) AS doc_id, unnest(range(1, len(chosen) + 1))::INTEGER AS place FROM best""")
def mmr_topk(t):
    pool = r.bm25(t("documents"), questions(t), "doc_id", 20).withColumn("score", v.squash(F.col("score")))
    texts = t("documents").select("doc_id", F.col("text").alias("content"))
    return r.mmr(pool, texts, "doc_id", 10)


_OWN = lambda x: f"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'), ' '), lambda w: w <> ''))"


@query(f"""WITH {BM25}, pool AS (SELECT query_id, doc_id, score FROM bm25 QUALIFY {TOP.format('doc_id', 20)}),
    sets AS (SELECT query_id, doc_id, score, {_OWN('b.text')} AS q, {_OWN('d.text')} AS c FROM pool JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id)),
    judged AS (SELECT query_id, doc_id, score, ln(share / (1 - share)) AS l FROM (SELECT *, (len(list_intersect(q, c)) + 0.5::DOUBLE) / (len(q) + 1) AS share FROM sets))
    SELECT query_id, doc_id, round(l, 6) AS rerank_score, round(1 / (1 + exp(-l)), 6) AS similarity FROM judged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY l DESC, score DESC, doc_id) <= 5""")
def rerank_topk(t):
    """Lexical results judged again by the stand-in for a cross-encoder."""
    pool = r.bm25(t("documents"), questions(t), "doc_id", 20).join(t("documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    return hooks.reranked(pool, questions(t), "doc_id", 5).select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), F.round("similarity", 6).alias("similarity"))


@query()
def ingest_and_search(t):
    """From texts to evidence: cleaned, gated, cut into chunks, the chunks gated and embedded (by the stand-in), and searched."""
    clean = spread(t("documents").select("doc_id", "text")).select("doc_id", f.clean_document(F.col("text")).alias("text")).where(f.worth_indexing(F.col("text")))
    found = chunks.chunk(clean, "doc_id", strategy="sentence", size=800, overlap=100).where(f.quality_chunk(F.col("content")))
    indexed = found.select("chunk_id", "doc_id", hooks.embedded(F.col("content")).alias("embedding"))
    asked = questions(t).select("query_id", hooks.embedded(F.col("text")).alias("embedding"))
    return r.cosine_topk(indexed, asked, "chunk_id", 5)
