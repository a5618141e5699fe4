"""Queries of what stands around a search: prompts, grades, scores, metadata of documents, archives of trees, statistics."""

from pyspark.sql import functions as F

from corvine.functions import constraints
from corvine.functions import text as f
from corvine.operators import context, hooks, layout
from corvine.operators import evaluation, rewriting
from corvine.operators import relational as rel
from corvine.operators import retrieval as r
from corvine.operators import texts as o
from corvine.operators import toolbox
from corvine.operators.registry import query
from corvine.plans.relational import ORGANIZATIONS, organizations
from corvine.plans.text import strip
from corvine.plans.retrieval import COSINES, TOP, WORDS, questions, vector_questions
from corvine.sources import files, metadata, stores
from corvine.sources.folders import shared_folder


@query("""WITH q AS (SELECT conv_id, text, conv_id % 3 AS n, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'block of ' || conv_id END AS blocks FROM conversations WHERE turn = 0),
    m AS (SELECT conv_id, [CASE WHEN conv_id % 2 = 0 THEN '【Prompt 模板】' || chr(10) || trim('Asked: ' || coalesce(text, '') || ' with ' || n || ' sources') END, CASE WHEN blocks <> '' THEN 'Context:' || chr(10) || blocks END, '【禁止回答策略】' || chr(10) || 'Say so.'] AS parts FROM q),
    k AS (SELECT conv_id, list_filter(parts, lambda x: x IS NOT NULL) AS parts FROM m)
    SELECT conv_id, unnest(range(len(parts)))::INTEGER AS place, 'system' AS role, unnest(parts) AS content FROM k""")
def prompt_assembly(t):
    asked = t("conversations").where("turn = 0")
    blocks = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit("block of "), "conv_id"))
    template = F.when(F.col("conv_id") % 2 == 0, "Asked: {user_question} with {{source_count}} sources ")
    messages = context.prompt(template, F.lit("Context:\n{context_blocks}"), F.lit("Say so."), blocks, {"user_question": F.col("text"), "source_count": F.col("conv_id") % 3})
    return asked.select("conv_id", F.posexplode(messages).alias("place", "m")).select("conv_id", "place", "m.role", "m.content")


@query("""SELECT conv_id, sum(length(coalesce(text, '')) // 2)::BIGINT AS total_tokens, round(sum(length(coalesce(text, '')) // 2) / 512.0::DOUBLE, 2) AS usage_ratio, count(*) AS message_count, sum(length(coalesce(text, '')) // 2) > 412 AS needs_compression FROM conversations GROUP BY conv_id""")
def token_stats(t):
    return context.token_stats(t("conversations"), 512, 100)


@query("""SELECT c_custkey, c_mktsegment AS role, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS organization_id, NOT (c_custkey % 7 = 1 AND (c_nationkey <= 3 OR c_nationkey % 2 = 0)) AS is_active FROM customer""")
def soft_delete(t):
    """Memberships of no organization (null) and of even ones are revoked for some members."""
    rows = t("customer").select("c_custkey", F.col("c_mktsegment").alias("role"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("organization_id"), F.lit(True).alias("is_active"))
    revoked = rows.where("c_custkey % 7 = 1 AND (organization_id IS NULL OR organization_id % 2 = 0)")
    return rel.deactivated(rows, revoked, ["c_custkey", "role", "organization_id"])


STATES = f"""WITH RECURSIVE {ORGANIZATIONS}, inside AS (SELECT node FROM org WHERE node IN ('r1', 'n3') UNION SELECT org.node FROM inside JOIN org ON org.parent = inside.node),
    s AS (SELECT node, node LIKE 'c%' AS is_file, node NOT LIKE '%5' AS has_file, node IN (SELECT node FROM inside) AS i, CASE WHEN node LIKE '%7' THEN 'failed' ELSE 'success' END AS status, CASE WHEN node LIKE '%7' THEN 'broken' END AS error FROM org)"""


def states(t):
    failed = F.col("node").endswith("7")
    return organizations(t).withColumns({"status": F.when(failed, "failed").otherwise("success"), "error": F.when(failed, "broken"), "archived_at": F.lit(None).cast("date")})


@query(STATES + """ SELECT node, CASE WHEN i THEN 'archived' ELSE status END AS status, CASE WHEN i THEN '2024-05-01' END AS archived_at, CASE WHEN NOT i THEN error END AS error FROM s""")
def archive_subtree(t):
    rows = states(t)
    return rel.archived(rows, rows.where("node IN ('r1', 'n3')").select("node"), "node", "parent", F.lit("2024-05-01").cast("date")).select("node", "status", F.col("archived_at").cast("string").alias("archived_at"), "error")


@query(STATES + """ SELECT node, CASE WHEN NOT i THEN 'archived' WHEN NOT is_file THEN 'success' WHEN has_file THEN 'processing' ELSE 'failed' END AS status,
    CASE WHEN NOT i OR is_file AND NOT has_file THEN '2024-05-01' END AS archived_at, CASE WHEN NOT i THEN NULL WHEN is_file AND NOT has_file THEN 'no file' END AS error FROM s""")
def restore_subtree(t):
    """All is archived; a part is restored, of which some files are gone."""
    rows = states(t)
    rows = rel.archived(rows, rows.where("parent IS NULL").select("node"), "node", "parent", F.lit("2024-05-01").cast("date"))
    back = rel.restored(rows, rows.where("node IN ('r1', 'n3')").select("node"), "node", "parent", ~F.col("node").startswith("c"), ~F.col("node").endswith("5"))
    return back.select("node", "status", F.col("archived_at").cast("string").alias("archived_at"), "error")


@query(f"""WITH {COSINES}, near AS (SELECT query_id, kb_id, vec_id, score FROM cosines QUALIFY row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, vec_id) <= 4),
    layers AS (SELECT *, CASE WHEN kb_id < 3 THEN 0 ELSE 1 END AS layer FROM near WHERE kb_id < 3 OR query_id % 2 = 0),
    merged AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY query_id) AS total_found FROM layers WINDOW w AS (PARTITION BY query_id ORDER BY greatest(score, 0) DESC, kb_id, vec_id) QUALIFY place <= 5),
    m AS (SELECT query_id, count(*) AS total_results, any_value(total_found) AS total_found, round(avg(score), 8) AS avg_similarity, list(kb_id ORDER BY place) AS kbs FROM merged GROUP BY query_id),
    a AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT kb_id)), ',') AS has_result_kb_ids, max(layer) > 0 AS fallback_used FROM layers GROUP BY query_id)
    SELECT query_id, total_results, total_found, avg_similarity, array_to_string(list_filter(kbs, lambda x, i: list_position(kbs, x) = i), ',') AS kb_ids, kbs[1] AS kb_id, has_result_kb_ids, fallback_used FROM m JOIN a USING (query_id)""")
def layered_merge_stats(t):
    """The second layer is asked for every other question."""
    rows = t("embeddings").withColumn("kb_id", F.col("vec_id") % 7)
    kbs = rows.select("kb_id").distinct()
    near = r.cosine_topk(rows, vector_questions(t).join(F.broadcast(kbs)).select(F.struct("query_id", "kb_id").alias("query_id"), "kb_id", "embedding"), "vec_id", 4, within=["kb_id"])
    found = near.select("query_id.*", F.col("vec_id").alias("chunk_id"), F.col("score").alias("similarity"), F.lit(None).cast("double").alias("final_score"), F.col("vec_id").cast("string").alias("content"))
    layers = found.withColumn("layer", F.when(F.col("kb_id") < 3, 0).otherwise(1)).where("layer = 0 OR query_id % 2 = 0")
    stats = r.merge_stats(r.merge_layers(layers), layers)
    return stats.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("kb_ids", "has_result_kb_ids")})


#: Words that mean the same, by syllables of the test data's languages.
SYNONYMS = [["en", "er", "re"], ["th", "st", "nd"], ["é", "ou"]]
_SAME = lambda words: f"list_transform({words}, lambda w: CASE WHEN w IN ('er', 're') THEN 'en' WHEN w IN ('st', 'nd') THEN 'th' WHEN w = 'ou' THEN 'é' ELSE w END)"


@query(f"""WITH docs AS (SELECT doc_id, {_SAME(WORDS.format('text'))} AS w FROM documents), asked AS (SELECT item_id AS query_id, {_SAME(WORDS.format('text'))} AS q FROM benchmark WHERE len({WORDS.format('text')}) > 0),
    terms AS (SELECT DISTINCT query_id, unnest(q) AS term FROM asked), words AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM docs),
    held AS (SELECT query_id, doc_id, count(*) AS n FROM words JOIN terms USING (term) GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, round(n / len(list_distinct(q)) + CASE WHEN n = len(list_distinct(q)) THEN 3.0 ELSE 0.0 END
      + CASE WHEN n = len(list_distinct(q)) AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') THEN 5.0 ELSE 0.0 END, 6) AS score FROM held JOIN asked USING (query_id) JOIN docs USING (doc_id))
    SELECT query_id, doc_id, score::DOUBLE AS score FROM scored QUALIFY {TOP.format('doc_id', 10)}""")
def boolean_synonyms(t):
    return r.boolean_phrase(t("documents"), questions(t), "doc_id", 10, tokens=f.with_synonyms(SYNONYMS))


@query("""WITH s AS (SELECT item_id AS query_id, i AS place, list_contains(list_filter(string_split(regexp_replace(lower(d.text[1:400]), '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), list_filter(string_split(regexp_replace(lower(b.text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')[1]) AS ok
      FROM benchmark b JOIN range(1, 6) r(i) ON true JOIN documents d ON d.doc_id = b.item_id * 3 + i)
    SELECT query_id, count(*) FILTER (ok)::INTEGER AS n_relevant, count(*)::INTEGER AS n_graded, count(*) FILTER (ok) >= 2 AS passes FROM s GROUP BY query_id""")
def llm_grade(t):
    """Evidence by rule, judged by the stand-in."""
    places = t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("place"))
    results = places.join(t("documents").select("doc_id", F.col("text").alias("content")), F.col("doc_id") == F.col("query_id") * 3 + F.col("place"))
    return hooks.graded(results, questions(t))


_SET = lambda x: f"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'), ' '), lambda x: x <> ''))"
_SHARE = lambda a, b: f"CASE WHEN len({a}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / len({a}) END"


@query(f"""WITH x AS (SELECT a.conv_id, q.text AS question, a.text AS answer, b.text AS c1, d.text AS c2 FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = 0 JOIN benchmark b ON b.item_id = a.conv_id % 20 JOIN documents d ON d.doc_id = a.conv_id WHERE a.turn = 1),
    s AS (SELECT conv_id, {_SET('question')} AS q, {_SET('answer')} AS a, {_SET("c1 || ' ' || c2")} AS c, {_SET('c1')} AS s1, {_SET('c2')} AS s2 FROM x),
    r AS (SELECT conv_id, {_SHARE('a', 'c')} AS faithfulness, {_SHARE('q', 'a')} AS answer_relevancy, (({_SHARE('q', 's1')} >= 0.5)::INTEGER + ({_SHARE('q', 's2')} >= 0.5)::INTEGER) / 2 AS context_precision, {_SHARE('a', 'c')} AS context_recall FROM s)
    SELECT conv_id, round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy, context_precision, round(context_recall, 6) AS context_recall, round((faithfulness + answer_relevancy + context_precision + context_recall) / 4, 6) AS overall_score FROM r""")
def quality_scores(t):
    said = lambda turn, name: t("conversations").where(F.col("turn") == turn).select("conv_id", F.col("text").alias(name))
    rows = said(1, "answer").join(said(0, "question"), "conv_id").join(t("benchmark").select("item_id", F.col("text").alias("c1")), F.col("conv_id") % 20 == F.col("item_id")).join(t("documents").select("doc_id", F.col("text").alias("c2")), F.col("conv_id") == F.col("doc_id"))
    scored = hooks.quality(rows.select("conv_id", "question", "answer", F.array("c1", "c2").alias("contexts"), F.lit(None).cast("string").alias("reference")))
    return scored.select("conv_id", *[F.round(c, 6).alias(c) for c in (*hooks.SCORES, "overall_score")])


@query(r"""WITH d AS (SELECT doc_id, doc_id || '.txt' AS filename, CASE WHEN doc_id % 3 = 0 THEN source END AS fd, lang AS fl, CASE WHEN doc_id % 5 = 0 THEN 'Posted 2019-3-' || (doc_id % 28 + 1) || '. ' || text ELSE text END AS text FROM documents),
    m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'dept' || doc_id % 9 ELSE fd END AS department, CASE WHEN doc_id % 4 = 0 THEN 'cat' || doc_id % 2 WHEN fd IS NOT NULL THEN fl END AS category, text FROM d),
    p AS (SELECT 'dept' || x AS department, '202' || x || '-01-15' AS publish_date FROM range(5) r(x)),
    t AS (SELECT *, substr(text, 1, 500) AS head FROM m), e AS (SELECT doc_id, department, category, regexp_extract(head, '(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})', 1) AS y, regexp_extract(head, '(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})', 2) AS mo, regexp_extract(head, '(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})', 3) AS dy FROM t)
    SELECT doc_id, department, category, coalesce(publish_date[1:4], CASE WHEN TRY_CAST(y AS INTEGER) BETWEEN 1990 AND 2030 THEN y END) AS publish_year, coalesce(publish_date, CASE WHEN TRY_CAST(y AS INTEGER) BETWEEN 1990 AND 2030 THEN y || '-' || lpad(mo, 2, '0') || '-' || lpad(dy, 2, '0') END) AS publish_date
    FROM e LEFT JOIN p USING (department)""")
def metadata_cascade(t):
    """Paths and the two lookup tables by rule; a fifth of the texts begin with a date."""
    dated = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Posted 2019-3-"), F.col("doc_id") % 28 + 1, F.lit(". "), "text")).otherwise(F.col("text"))
    folder = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", F.lit("/data/output"), "source", "lang")).otherwise(F.lit("/data"))
    docs = t("documents").select("doc_id", F.concat(folder, F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), dated.alias("text"))
    by_file = t("documents").where("doc_id % 4 = 0").select(F.concat(F.lit("k"), "doc_id").alias("key"), F.concat("doc_id", F.lit(".txt")).alias("filename"), F.concat(F.lit("dept"), F.col("doc_id") % 9).alias("department"), F.concat(F.lit("cat"), F.col("doc_id") % 2).alias("category"))
    by_page = t.spark.range(5).select(F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit("dept"), "id").alias("department"), F.concat(F.lit("202"), "id", F.lit("-01-15")).alias("publish_date"))
    return metadata.described(docs, by_file, by_page).select("doc_id", "department", "category", "publish_year", "publish_date")


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '交通学院' WHEN 1 THEN '新闻网-交通学院' WHEN 2 THEN '新闻网-计算机学院' WHEN 3 THEN '计算机科学与工程学院' ELSE '图书馆' END AS department FROM documents),
    q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN '交通学院' WHEN 1 THEN '计算机科学与工程学院' END AS wanted FROM benchmark WHERE item_id < 9)
    SELECT query_id, count(*) AS n FROM q JOIN d ON wanted IS NULL OR department = wanted OR wanted = '交通学院' AND department = '新闻网-交通学院' OR wanted = '计算机科学与工程学院' AND department IN ('新闻网-计算机学院', '新闻网-计算机科学与工程学院') GROUP BY query_id""")
def department_variants(t):
    """Documents by department, of which news are filed under other names, for questions that name one or none; counted by department first."""
    names = F.array(*map(F.lit, ("交通学院", "新闻网-交通学院", "新闻网-计算机学院", "计算机科学与工程学院", "图书馆")))
    filed = t("documents").select(F.get(names, (F.col("doc_id") % 5).cast("int")).alias("department")).groupBy("department").agg(F.count("*").alias("m"))
    asked = t("benchmark").where("item_id < 9").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "交通学院").when(F.col("item_id") % 3 == 1, "计算机科学与工程学院").alias("wanted"))
    met = asked.join(F.broadcast(filed), constraints.constrained(department=F.col("wanted")))  # a row for each name in use
    return met.groupBy("query_id").agg(F.sum("m").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_join_without_large_orders(t):
    large = t("orders").where("o_totalprice > 250000").select("o_custkey")
    return t("customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(r"""WITH d AS (SELECT doc_id, substr(CASE doc_id % 4 WHEN 0 THEN 'Date: 20' || (doc_id % 60 + 10) || '/' || (doc_id % 12 + 1) || '/' || (doc_id % 9 + 1) || ' ' || text WHEN 1 THEN '2011年' || (doc_id % 12 + 1) || '月 ' || text ELSE text END, 1, 500) AS head FROM documents),
    m AS (SELECT doc_id, head, regexp_matches(head, '\d{4}[-年/.]\d{1,2}[-月/.]\d{1,2}') AS whole, regexp_extract(head, '(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})', 1) AS y, regexp_extract(head, '(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})', 2) AS mo, regexp_extract(head, '(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})', 3) AS dy,
      regexp_extract(head, '(\d{4})\s*年\s*\d{1,2}\s*月', 1) AS short FROM d),
    r AS (SELECT doc_id, CASE WHEN whole THEN y ELSE short END AS publish_year, CASE WHEN whole THEN y || '-' || lpad(mo, 2, '0') || '-' || lpad(dy, 2, '0') END AS publish_date FROM m)
    SELECT doc_id, publish_year, publish_date FROM r WHERE publish_year <> '' AND publish_year::INTEGER BETWEEN 1990 AND 2030""")
def document_dates_planted(t):
    """Dates and months written by rule before half of the texts, some of them outside the range."""
    n = F.col("doc_id")
    text = F.when(n % 4 == 0, F.concat(F.lit("Date: 20"), n % 60 + 10, F.lit("/"), n % 12 + 1, F.lit("/"), n % 9 + 1, F.lit(" "), "text")).when(n % 4 == 1, F.concat(F.lit("2011年"), n % 12 + 1, F.lit("月 "), "text")).otherwise(F.col("text"))
    return t("documents").select("doc_id", f.publish_year(text).alias("publish_year"), f.publish_date(text).alias("publish_date")).where("publish_year IS NOT NULL")


@query(r"""WITH texts AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text),
    tokens AS (SELECT id, regexp_extract_all(lower(text), '[^ 	-
]+') AS w FROM texts),
    grams AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM tokens)),
    sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
    met AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)
    SELECT a AS doc_a, b AS doc_b, round(common / (x.n + y.n - common), 6) AS similarity FROM met JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common)""")
def ngram_jaccard_documents(t):
    """Pairs of distinct texts of all documents (each named by its least doc_id; see text_classes) with a similarity of 0.8 or more."""
    found = o.similar_pairs(t("documents"), "doc_id", "text", words=5, least=0.8)
    return found.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS class_id FROM documents")
def text_classes(t):
    """Each document's class of equal texts."""
    rows = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.min("doc_id").alias("class_id")), "h").select("doc_id", "class_id")


@query("""WITH p AS (SELECT doc_id, source, lang FROM documents), n AS (SELECT DISTINCT source AS node, '' AS parent, true AS is_folder FROM p UNION ALL SELECT DISTINCT source || '/' || lang, source, true FROM p UNION ALL SELECT source || '/' || lang || '/' || doc_id, source || '/' || lang, false FROM p)
    SELECT parent, node, is_folder, row_number() OVER (PARTITION BY parent ORDER BY is_folder DESC, node)::INTEGER AS place FROM n QUALIFY place <= 20""")
def folders_first_listing(t):
    """The first 20 entries of each folder of a tree of documents, folders first."""
    tree = files.folders(t("documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path")))
    listed = r.top(tree, 20, F.desc("is_folder"), F.asc("node"), by="parent", rank="place")
    return listed.select("parent", "node", "is_folder", "place")


@query()
def enhanced_retrieval(t):
    """The question, its first half and its second half are the paths; the stand-in judges."""
    asked, docs = questions(t), t("documents")
    words = F.split("text", " ")
    half = F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))
    part = lambda start, n: asked.select("query_id", F.array_join(F.slice(words, start, n), " ").alias("text"))
    search = lambda q: r.bm25(docs, q, "doc_id", 20)
    contents = docs.select("doc_id", F.col("text").alias("content"))
    paths = [(asked, search), (part(F.lit(1), half), search), (part(half + 1, F.size(words)), search)]
    return r.enhanced(asked, paths, contents, "doc_id", 5, lambda pool, q: hooks.reranked(pool, q, "doc_id", 20))


@query("""WITH e AS (SELECT *, event_id % 8 AS k FROM events), n AS (SELECT n_name, row_number() OVER (PARTITION BY d ORDER BY n_name) AS place, d::VARCHAR AS d FROM nation, range(10) r(d) WHERE contains(n_name, d::VARCHAR)),
    found AS (SELECT event_id AS call_id, n_name FROM e JOIN n ON k = 7 AND d = ((event_id // 8) % 10)::VARCHAR AND place <= 3)
    SELECT e.event_id AS call_id, CASE k WHEN 3 THEN 'translator' WHEN 4 THEN 'datetime_info' WHEN 5 THEN 'datetime_info' WHEN 7 THEN 'database_query' ELSE 'calculator' END AS tool,
      CASE k WHEN 0 THEN round((event_id % 7 + 2) * 3.5::DOUBLE - sqrt((event_id % 9)::DOUBLE), 6) WHEN 4 THEN date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE END AS value, n_name AS name,
      CASE k WHEN 1 THEN 'missing: expression' WHEN 2 THEN 'expression must be of type string' WHEN 3 THEN 'unknown tool: translator' WHEN 5 THEN 'action must be one of now, diff' WHEN 6 THEN 'arguments must be a JSON object' END AS error
    FROM e LEFT JOIN found ON found.call_id = e.event_id""")
def tool_calls(t):
    """A call for each event, by rule: arithmetic, dates, a lookup, and calls that don't fit."""
    box = toolbox.Toolbox(toolbox.calculator(), toolbox.dates(), toolbox.lookup({"nation": (t("nation"), "n_name")}))
    k, n = F.col("event_id") % 8, F.col("event_id")
    formula = F.format_string('{"expression": "(%d + 2) * 3.5 - sqrt(%d)"}', n % 7, n % 9)
    diff = F.format_string('{"action": "diff", "date1": "2024-01-01", "date2": "%s"}', F.date_format("ts", "yyyy-MM-dd"))
    look = F.format_string('{"table": "nation", "keyword": "%d", "limit": 3}', F.floor(n / 8) % 10)
    arguments = F.when(k == 0, formula).when(k == 2, F.format_string('{"expression": %d}', n)).when(k == 4, diff).when(k == 5, F.lit('{"action": "later"}')).when(k == 6, F.format_string("[%d]", n)).when(k == 7, look).otherwise("{}")
    tool = F.when(k == 3, "translator").when(k.isin(4, 5), "datetime_info").when(k == 7, "database_query").otherwise("calculator")
    found = box.answered(t("events").select(n.alias("call_id"), tool.alias("tool"), arguments.alias("arguments")))
    number = lambda field: F.get_json_object("result", field).cast("double")
    return found.select("call_id", "tool", F.round(F.coalesce(number("$.result"), number("$.diff_days")), 6).alias("value"), F.get_json_object("result", "$.n_name").alias("name"), "error")


@query("""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'database_query,knowledge_search' WHEN 1 THEN 'calculator,knowledge_search' WHEN 2 THEN 'calculator,datetime_info,knowledge_search' ELSE 'knowledge_search' END AS tools FROM conversations WHERE NOT contains(coalesce(text, ''), '%')""")
def tools_offered(t):
    """Messages that name what tools are about, by rule."""
    box = toolbox.Toolbox(toolbox.knowledge_search(lambda q, n: q), toolbox.lookup({"nation": (t("nation"), "n_name")}), toolbox.calculator(), toolbox.dates())
    words = F.get(F.array(*map(F.lit, ("哪个学院 ", "计算 ", "今天加 ", ""))), (F.col("conv_id") % 4).cast("int"))
    said = t("conversations").where(~F.contains(F.coalesce("text", F.lit("")), F.lit("%"))).select("conv_id", "turn", F.concat(words, F.coalesce("text", F.lit(""))).alias("text"))
    return box.offered(said).select("conv_id", "turn", F.array_join(F.array_sort("tools"), ",").alias("tools"))


@query("""WITH e AS (SELECT vec_id, vec_id % 7 AS kb_id, CASE WHEN vec_id % 7 = 2 AND vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS content FROM embeddings WHERE NOT (vec_id % 7 = 3 AND vec_id % 2 = 0) AND vec_id % 7 <> 4),
    a AS (SELECT kb_id, content, count(*) AS n, sum(vec_id)::BIGINT AS total FROM e WHERE kb_id IN (2, 3, 4) GROUP BY ALL)
    SELECT k AS kind, a.* FROM a, (SELECT unnest(['folders', 'committed']) AS k)""")
def store_back_ends(t):
    """The same changes in both stores: some chunks replaced, some deleted, a collection dropped; then three collections are read."""
    chunks = t("embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("old").alias("content"), F.col("embedding").cast("array<float>").alias("embedding"), (F.col("vec_id") % 7).alias("kb_id"))
    number = F.col("chunk_id").cast("long")
    read = []
    for kind in ("folders", "committed"):
        store = stores.store(t.spark, shared_folder(t.spark, f"store-{kind}"), kind)
        store.append(chunks)
        store.upsert(chunks.where((F.col("kb_id") == 2) & (number % 5 == 0)).withColumn("content", F.lit("new")))
        store.delete(3, chunks.where(number % 2 == 0), ["chunk_id"])
        store.drop(4)
        read.append(store.read(2, 3, 4).groupBy("kb_id", "content").agg(F.count("*").alias("n"), F.sum(number).alias("total")).select(F.lit(kind).alias("kind"), "*"))
    return read[0].union(read[1])


@query("""WITH p AS (SELECT *, p_partkey // 20 AS page, p_partkey % 20 AS r FROM part),
    c AS (SELECT a.page, a.r, '| ' || a.p_partkey || ' | ' || a.p_name || ' | ' || b.p_brand || ' | ' || a.p_size || ' |' || CASE WHEN a.r = 0 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END AS line FROM p a JOIN p b ON b.page = a.page AND b.r = a.r - a.r % 4)
    SELECT page, string_agg(line, chr(10) ORDER BY r) || chr(10) || chr(10) || 'Page ' || page AS text FROM c GROUP BY page""")
def pdf_tables(t):
    """Parts as pages of a printed list: a table of twenty rows, of which four at a time share a merged cell, under a title."""
    n = F.col("p_partkey")
    parts = t("part").select(F.floor(n / 20).alias("page"), (n % 20).alias("r"), F.col("p_partkey").cast("string").alias("number"), "p_name", "p_brand", F.col("p_size").cast("string").alias("size"))

    def word(x, text, top):
        return F.struct(x.cast("double").alias("x0"), (x + 5 * F.length(text)).cast("double").alias("x1"), top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"), text.alias("text"))

    top = 100 + 12 * F.col("r")
    names = F.split("p_name", " ")
    before = lambda i: F.aggregate(F.slice(names, F.lit(1), i), F.lit(0), lambda s, w: s + F.length(w) + 1)
    spoken = F.transform(names, lambda w, i: word(120 + 5 * before(i), w, top))
    row = F.concat(F.array(word(F.lit(50), F.col("number"), top), word(F.lit(700), F.col("size"), top)), spoken, F.when(F.col("r") % 4 == 0, F.array(word(F.lit(600), F.col("p_brand"), top))).otherwise(F.array()))
    words = parts.select("page", F.explode(row).alias("w")).select("page", "w.*")
    pages = parts.select("page").distinct()
    title = pages.select("page", F.explode(F.array(word(F.lit(50), F.lit("Page"), F.lit(20)), word(F.lit(80), F.col("page").cast("string"), F.lit(20)))).alias("w")).select("page", "w.*")
    boxes = pages.select("page", F.lit(0).alias("table"), F.lit(40.0).alias("x0"), F.lit(95.0).alias("top"), F.lit(800.0).alias("x1"), F.lit(345.0).alias("bottom"))
    return layout.page_texts(words.union(title), boxes)


def _layout(path, content):
    n = int(path.split(".")[0])
    if n % 3 == 1:
        raise OSError("no layout")
    return content.decode() if n % 3 == 0 else None


def _tables(path, content):
    n = int(path.split(".")[0])
    return "short" if n % 4 == 0 else content.decode() if n % 5 == 0 else None


def _layer(path, content):
    n = int(path.split(".")[0])
    if n % 7 == 0:
        raise ValueError("no text layer")
    return content.decode()[:10] if n % 2 == 0 else content.decode()


def _recognised(path, content):
    n = int(path.split(".")[0])
    if n % 11 == 0:
        raise RuntimeError("no image")
    return f"page {n}" if n % 13 else ""


@query(f"""WITH d AS (SELECT doc_id, nullif({strip('text')}, '') AS x, nullif({strip('text[1:10]')}, '') AS x10 FROM documents),
    a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN x END AS t1, CASE WHEN doc_id % 4 = 0 THEN 'short' WHEN doc_id % 5 = 0 THEN x END AS t2, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN x10 ELSE x END AS t3, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN NULL ELSE 'page ' || doc_id END AS t4 FROM d),
    s AS (SELECT *, CASE WHEN length(t1) >= 20 THEN 1 WHEN length(t2) >= 20 THEN 2 WHEN length(t3) >= 20 THEN 3 WHEN t4 IS NOT NULL THEN 4 END AS k FROM a),
    f AS (SELECT *, CASE k WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 WHEN 4 THEN t4 ELSE coalesce(t3, t2, t1) END AS text FROM s)
    SELECT doc_id || '.pdf' AS path, sha256(text) AS text_sha256, CASE k WHEN 1 THEN 'layout' WHEN 2 THEN 'tables' WHEN 3 THEN 'layer' WHEN 4 THEN 'recognised' END AS stage, coalesce(k, 4) AS n_attempts,
      CASE WHEN text IS NULL THEN CASE WHEN doc_id % 11 = 0 THEN 'RuntimeError: no image' WHEN doc_id % 7 = 0 THEN 'ValueError: no text layer' WHEN doc_id % 3 = 1 THEN 'OSError: no layout' ELSE 'no text' END END AS error FROM f""")
def pdf_cascade(t):
    """Four parsers by rule in the place of those for PDF."""
    given = t("documents").select(F.concat("doc_id", F.lit(".pdf")).alias("path"), F.col("text").cast("binary").alias("content"))
    found, _ = files.cascade(given, [("layout", _layout), ("tables", _tables), ("layer", _layer), ("recognised", _recognised)])
    return found.select("path", F.sha2("text", 256).alias("text_sha256"), "stage", "n_attempts", "error")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
    q AS (SELECT conv_id, turn, text FROM m WHERE back = 1), h AS (SELECT m.conv_id, arg_max(m.text, m.turn) FILTER (m.role = 'user') AS said, count(*) AS n FROM m WHERE back BETWEEN 2 AND 7 GROUP BY m.conv_id)
    SELECT q.conv_id AS query_id, CASE WHEN conv_id % 5 = 0 OR n IS NULL THEN text ELSE coalesce(trim(CASE WHEN said IS NULL THEN text ELSE substr(said, 1, 300) || ' ' || text END), text) END AS condensed FROM q LEFT JOIN h USING (conv_id)""")
def condense_follow_ups(t):
    """The last message of each conversation with the six before it; the stand-in's answer fails for every fifth."""
    messages = t("conversations")
    asked = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    rows = asked.select(F.col("conv_id").alias("query_id"), F.concat(F.when(F.col("conv_id") % 5 == 0, "fail:").otherwise(""), F.element_at("m", -1)["content"]).alias("text"), F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))

    def model(question, history):
        if question.startswith("fail:"):
            raise OSError("no answer")
        return f'"{rewriting.after_last_question(question, history)}"'

    return rewriting.condensed(rows, model).select("query_id", F.regexp_replace("condensed", "^fail:", "").alias("condensed"))


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS k FROM documents)
    SELECT doc_id AS query_id, CASE k WHEN 0 THEN '2019' WHEN 2 THEN '2021' END AS year, CASE k WHEN 1 THEN '计算机科学与工程学院' WHEN 2 THEN '测绘与空间信息学院' WHEN 3 THEN '数据中心' END AS department, CASE k WHEN 2 THEN '通知' END AS category,
      CASE k WHEN 0 THEN '2019年的活动 ' || doc_id WHEN 1 THEN '计科的课程 ' || doc_id WHEN 2 THEN '活动' WHEN 3 THEN 'question ' || doc_id WHEN 4 THEN 'question ' || doc_id ELSE 'question ' || doc_id END AS semantic_query,
      CASE WHEN k < 2 THEN 'rule' WHEN k < 4 THEN 'model' ELSE 'none' END AS source FROM d""")
def question_constraints(t):
    """A question for each document, by rule: some that rules understand, some that a model does, some that it fails on."""
    n, k = F.col("doc_id"), F.col("doc_id") % 6
    asked = t("documents").select(n.alias("query_id"), F.when(k == 0, F.concat(F.lit("2019年的活动 "), n)).when(k == 1, F.concat(F.lit("计科的课程 "), n)).otherwise(F.concat(F.lit("question "), n)).alias("text"))

    def model(question):
        match int(question.split()[-1]) % 6:
            case 2:
                return '好的 {"year": "2021", "department": "测绘与空间信息", "category": "通知", "semantic_query": "活动"}'
            case 3:
                return '{"department": "数据中心", "semantic_query": ""}'
            case 4:
                return "no idea"
        raise OSError("no answer")

    return rewriting.understood(asked, model).drop("text")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '教务处' WHEN 1 THEN '交通学院' WHEN 2 THEN 'xyz' WHEN 3 THEN '' END AS department FROM documents""")
def departments_of_sites(t):
    pages = F.array(*map(F.lit, ("https://jwc.example.edu/a/b.htm", "http://jt.example.edu", "http://xyz.example.edu/x", "http://jwc.example.org/")), F.lit(None))
    return t("documents").select("doc_id", constraints.department_of_site(F.get(pages, (F.col("doc_id") % 5).cast("int")), "example.edu").alias("department"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN NULL ELSE quality::DOUBLE END AS q, toxic / 2.0::DOUBLE AS x FROM labels)
    SELECT count(*) AS total, count(q) AS succeeded, count(*) - count(q) AS failed, round(avg(q), 4) AS avg_quality, round(avg(x) FILTER (q IS NOT NULL), 4) AS avg_toxic FROM s""")
def batch_averages(t):
    scored = t("labels").select(F.when(F.col("doc_id") % 9 != 4, F.col("quality").cast("double")).alias("quality"), (F.col("toxic") / 2.0).alias("toxic"))
    return evaluation.batch_averages(scored, ["quality", "toxic"], F.col("quality").isNull())


@query("SELECT o_orderkey, o_totalprice, true AS at_limit FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 10")
def hard_limit(t):
    return rel.limited(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], limit=5000, offset=10, most=500)
