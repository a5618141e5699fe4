"""Queries of the text functions: cleaning, gates, tokens, extraction, exact and n-gram duplicates."""

from pyspark.sql import functions as F

from corvine.functions import constraints, tools
from corvine.functions import text as f
from corvine.operators import texts as o
from corvine.operators.registry import query
from corvine.sources import files

#: White space for DuckDB's patterns.
SPACE = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
#: Words that the menus of the table pages may hold, in place of the default list.
MENU = ["The", "the", "and", "And", "of", "to", "To", "in", "In", "that", "is", "Of"]
IN_MENU = ", ".join(f"'{w}'" for w in MENU)

HTML_TEXT = r"""replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<template\b.*?</template\s*>|<noscript\b.*?</noscript\s*>', ' ', 'gis'),
        '<(/?(p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|main|blockquote|pre)\b[^>]*|br\b[^>]*)>', chr(10), 'gi'), '<[^>]*>', ' ', 'gs'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')"""
PAGE_TEXT = rf"""page_texts AS (SELECT page_id, trim(regexp_replace(regexp_replace({HTML_TEXT}, '[ \t\r\f\x{{0b}}]+', ' ', 'g'), ' ?(\n ?)+', chr(10), 'g'), chr(10) || ' ') AS body FROM pages)"""


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"



@query(rf"WITH {PAGE_TEXT} SELECT page_id, length(body)::INTEGER AS n_chars, body FROM page_texts")
def page_text_extract(t):
    return t("pages").select("page_id", f.html_text(F.col("html")).alias("body")).select("page_id", F.length("body").alias("n_chars"), "body")


# A short line goes if three menu lines in a row lie behind it with only menu and short lines since.
@query(rf"""WITH {PAGE_TEXT},
    lines AS (SELECT page_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS pos FROM page_texts),
    kinds AS (SELECT page_id, pos, {strip('line')} AS line, CASE WHEN {strip('line')} = '' THEN 'b' WHEN {strip('line')} IN ({IN_MENU}) THEN 'n' WHEN length({strip('line')}) <= 25 THEN 's' ELSE 'o' END AS kind
      FROM lines WHERE NOT (lower(line) LIKE '%copyright%' OR lower(line) LIKE '%all rights reserved%')),
    threes AS (SELECT *, CASE WHEN kind = 'n' AND lag(kind) OVER w = 'n' AND lag(kind, 2) OVER w = 'n' THEN pos END AS three, CASE WHEN kind IN ('b', 'o') THEN pos END AS stop FROM kinds WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
    kept AS (SELECT page_id, pos, line, kind FROM threes WINDOW v AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      QUALIFY kind = 'b' OR (kind <> 'n' AND length(line) > 2 AND NOT (kind = 's' AND coalesce(max(three) OVER v, -1) > coalesce(max(stop) OVER v, -1)))),
    blanks AS (SELECT *, count(*) FILTER (kind = 'b') OVER (PARTITION BY page_id ORDER BY pos) AS nb FROM kept),
    firsts AS (SELECT page_id, pos, line, nb FROM blanks WHERE kind <> 'b' QUALIFY row_number() OVER (PARTITION BY page_id, line ORDER BY pos) = 1),
    led AS (SELECT *, CASE WHEN lag(nb) OVER w IS NULL THEN '' WHEN lag(nb) OVER w < nb THEN chr(10) || chr(10) ELSE chr(10) END AS lead FROM firsts WINDOW w AS (PARTITION BY page_id ORDER BY pos))
    SELECT page_id, coalesce(string_agg(lead || line, '' ORDER BY pos), '') AS body FROM page_texts LEFT JOIN led USING (page_id) GROUP BY page_id""")
def web_clean_pages(t):
    return t("pages").select("page_id", f.clean_web(f.html_text(F.col("html")), MENU).alias("body"))


@query(rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
    bare AS (SELECT doc_id, pos, {strip('line')} AS line FROM lines),
    kept AS (SELECT *, count(*) FILTER (line = '') OVER (PARTITION BY doc_id ORDER BY pos) AS nb FROM bare
      WHERE NOT regexp_matches(line, '(?i)^([\s–—-]*\d+[\s–—-]*|第\s*\d+\s*页|page\s+\d+\s*)$') AND NOT (length(line) = 1 AND NOT regexp_matches(line, '[\p{{L}}\p{{N}}]'))),
    firsts AS (SELECT doc_id, pos, line, nb FROM kept WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) = 1),
    led AS (SELECT *, CASE WHEN lag(nb) OVER w IS NULL THEN '' WHEN lag(nb) OVER w < nb THEN chr(10) || chr(10) ELSE chr(10) END AS lead FROM firsts WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    joined AS (SELECT doc_id, string_agg(lead || line, '' ORDER BY pos) AS body FROM led GROUP BY doc_id)
    SELECT doc_id, length(coalesce(body, ''))::INTEGER AS n_chars, sha256(coalesce(body, '')) AS body_sha256 FROM documents LEFT JOIN joined USING (doc_id)""")
def doc_clean_lines(t):
    cleaned = t("documents").select("doc_id", f.clean_document(F.col("text")).alias("body"))
    return cleaned.select("doc_id", F.length("body").alias("n_chars"), F.sha2("body", 256).alias("body_sha256"))


@query(rf"""SELECT doc_id, size AS n_chars, m AS n_meaningful, size >= 20 AND m >= size * 0.6 AND m >= 10 AS worth FROM (SELECT doc_id,
    length({strip('text')})::INTEGER AS size, length(regexp_replace(text, '[^\p{{L}}\p{{N}}，。！？、；："（）]', '', 'g'))::INTEGER AS m FROM documents)""")
def index_gate(t):
    text = F.col("text")
    meaningful = F.length(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{f.MEANINGFUL}]", ""))
    return t("documents").select("doc_id", F.length(f.strip(text)).alias("n_chars"), meaningful.alias("n_meaningful"), f.worth_indexing(text).alias("worth"))


@query(rf"""WITH {PAGE_TEXT}, lines AS (SELECT page_id, {strip('unnest(string_split(body, chr(10)))')} AS line FROM page_texts)
    SELECT page_id, coalesce(n > 0 AND NOT (hits >= 3 AND hits > 0.3 * n) AND total >= 15 * n AND short <= 0.6 * n, false) AS good FROM (SELECT page_id, count(*) FILTER (line <> '') AS n, sum(length(line)) AS total,
      count(*) FILTER (line <> '' AND length(line) <= 10) AS short, count(*) FILTER (line IN ({IN_MENU})) AS hits FROM lines GROUP BY page_id)""")
def chunk_quality_gate(t):
    return t("pages").select("page_id", f.quality_chunk(f.html_text(F.col("html")), MENU).alias("good"))


TOKENS = r"""tokens AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'), ' ')) AS word FROM documents)
    WHERE word <> '' AND word NOT IN (""" + ", ".join(f"'{w}'" for w in f.STOPWORDS) + "))"


@query(f"WITH {TOKENS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tokens GROUP BY word")
def tokens_word(t):
    """Counted in each document's own row, so that what is shuffled is a row for each word and task and none for each document. Only if a doc_id is repeated, words are counted by
    document first, as a document's rows must then meet."""
    docs = t("documents")
    found = docs.select("doc_id", f.words(F.col("text")).alias("w"))
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        words = found.select("doc_id", F.explode("w").alias("word"))
        return words.groupBy("word", "doc_id").count().groupBy("word").agg(F.sum("count").alias("n"), F.count("doc_id").alias("n_docs"))
    one = lambda n, n_docs: lambda word: F.struct(word.alias("word"), F.lit(n).alias("n"), n_docs.alias("n_docs"))
    held = F.when(F.col("doc_id").isNotNull(), 1).otherwise(0)
    rows = found.select(F.explode(F.concat(F.transform("w", one(1, F.lit(0))), F.transform(F.array_distinct("w"), one(0, held)))).alias("x")).select("x.*")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


@query(rf"""WITH plain AS (SELECT item_id, regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_{SPACE}]', ' ', 'g') AS p FROM benchmark),
    pairs AS (SELECT item_id, {strip('p[i:i + 1]')} AS pair FROM (SELECT item_id, p, unnest(range(1, length(p))) AS i FROM plain))
    SELECT pair, count(*) AS n FROM pairs WHERE pair <> '' AND pair NOT IN ({", ".join(f"'{w}'" for w in f.STOPWORDS)}) GROUP BY pair""")
def tokens_bigram(t):
    return t("benchmark").select(F.explode(f.bigrams(F.col("text"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, host, split_part(host, '.', 1) AS subdomain, path, regexp_extract(path, '^/([^/]*)/', 1) AS directory FROM
    (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def url_parts(t):
    return t("pages").select("page_id", *[c.alias(n) for n, c in f.url_parts(F.col("url")).items()])


@query("SELECT min(doc_id) AS first_id, count(*) AS n_copies, max(doc_id) AS last_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_dup_docs(t):
    return o.exact_copies(t("documents"), "doc_id", "text")


@query("""WITH texts AS (SELECT text, min(item_id) AS id FROM benchmark GROUP BY text),
    grams AS (SELECT DISTINCT id, word1 || ' ' || word2 || ' ' || word3 || ' ' || word4 || ' ' || word5 AS gram FROM (SELECT id, w[i] AS word1, w[i+1] AS word2, w[i+2] AS word3, w[i+3] AS word4, w[i+4] AS word5
      FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT id, regexp_extract_all(lower(text), '[^ \\t-\\r]+') AS w FROM texts)))),
    sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
    met AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)
    SELECT a AS item_a, b AS item_b, round(common / (x.n + y.n - common), 6) AS similarity FROM met JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common)""".replace("\\\\", "\\"))
def ngram_jaccard_pairs(t):
    """Pairs of distinct benchmark texts with five-word shingle similarity of 0.8 or more (prefix filter, then exact)."""
    found = o.similar_pairs(t("benchmark"), "item_id", "text", words=5, least=0.8)
    return found.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.round("similarity", 6).alias("similarity"))


MATCHES = """squeezed AS (SELECT item_id, substr(replace(replace(text, chr(10), ''), ' ', ''), 1, 100) AS t FROM benchmark),
    pieces AS (SELECT DISTINCT item_id, t[s * 30 + 1 : s * 30 + 30] AS piece FROM (SELECT item_id, t, unnest(range(4)) AS s FROM squeezed) WHERE t[s * 30 + 1 : s * 30 + 30] <> '')"""


@query(f"""WITH {MATCHES}, docs AS (SELECT doc_id, replace(replace(text, chr(10), ''), ' ', '') AS t FROM documents)
    SELECT DISTINCT doc_id, item_id FROM docs JOIN pieces ON contains(t, piece) WHERE length(piece) = 30""")
def content_match_benchmark(t):
    return o.contents(t("documents"), t("benchmark"), "doc_id", "item_id")


@query(r"""SELECT conv_id, turn, regexp_matches(text, '(?i)(ignore.{0,15}(previous|above|all).{0,15}(instructions?|rules?|prompts?))|(do\s*not\s*follow.{0,15}(rules?|instructions?))|(system\s*prompt)|(repeat.{0,10}(system|initial).{0,10}(prompt|instruction))') AS flagged FROM conversations""")
def injection_flags(t):
    return t("conversations").select("conv_id", "turn", f.asks_injection(F.col("text")).alias("flagged"))


TOPICS = ["treth", "ción", "chen", "eau", "ould"]


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{w}'" for w in TOPICS) + " END AS topic FROM conversations")
def forbidden_topic_first(t):
    return t("conversations").select("conv_id", "turn", f.first_topic(F.col("text"), F.array(*map(F.lit, TOPICS))).alias("topic"))


@query("SELECT event_type, (props->>'$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props_extract(t):
    return t("events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' (' || event_type || ')' AS message FROM events")
def template_render(t):
    values = {"user": F.col("user_id"), "what": F.col("event_type"), "none": F.lit(None)}
    return t("events").select("event_id", f.render(F.lit("user {{user}} did {what} ({what}){none}"), values).alias("message"))


@query("""SELECT event_id, sha256('["' || user_id || '","' || event_type || '"]')[1:20] AS key FROM events""")
def cache_key_sha(t):
    return t("events").select("event_id", f.cache_key(F.col("user_id"), F.col("event_type")).alias("key"))


@query(r"""WITH d AS (SELECT doc_id, substr(text, 1, 500) AS head FROM documents), m AS (SELECT doc_id, regexp_extract(head, '(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})', 1) AS y, regexp_extract(head, '(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})', 2) AS mo,
    regexp_extract(head, '(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})', 3) AS dy FROM d) SELECT doc_id, y AS publish_year, y || '-' || lpad(mo, 2, '0') || '-' || lpad(dy, 2, '0') AS publish_date FROM m WHERE y <> '' AND y::INTEGER BETWEEN 1990 AND 2030""")
def document_dates(t):
    text = F.col("text")
    return t("documents").select("doc_id", f.publish_year(text).alias("publish_year"), f.publish_date(text).alias("publish_date")).where("publish_year IS NOT NULL")


@query("""SELECT doc_id, CASE WHEN s >= 0.75 THEN '高' WHEN s >= 0.55 THEN '中' WHEN s > 0 THEN '低' ELSE '不足' END AS label, n_tokens FROM (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS s, length(text) // 2 AS n_tokens FROM documents)""")
def relevance_labels(t):
    return t("documents").select("doc_id", f.relevance_label((F.col("n_chars") % 100) / F.lit(100.0)).alias("label"), f.token_count(F.col("text")).alias("n_tokens"))


@query("""WITH p AS (SELECT page_id, list_filter(string_split(host || path, '/'), lambda x: x <> '') AS p FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)),
    n AS (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM p) SELECT array_to_string(p[1:d], '/') AS node, array_to_string(p[1:d - 1], '/') AS parent, d::INTEGER AS depth, bool_or(d < len(p)) AS is_folder FROM n GROUP BY ALL""")
def path_tree(t):
    parts = f.url_parts(F.col("url"))
    return files.folders(t("pages").select(F.concat(parts["host"], parts["path"]).alias("path")))


NAMES = {"the": "short name", "thele": "longer name", "des": "another", "und": "fourth"}


@query("SELECT doc_id, CASE WHEN contains(text, 'thele') THEN 'longer name' WHEN contains(text, 'the') THEN 'short name' WHEN contains(text, 'des') THEN 'another' WHEN contains(text, 'und') THEN 'fourth' END AS name FROM documents")
def constraint_names(t):
    """Names in a text, the longest first."""
    return t("documents").select("doc_id", constraints.named_in(F.col("text"), NAMES).alias("name"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice >= 100000 AND (o_orderpriority = '1-URGENT' OR o_custkey < 100)")
def metadata_where(t):
    where = {"$and": [{"o_orderstatus": {"$in": ["F", "P"]}}, {"o_totalprice": {"$gte": 100000}}, {"$or": [{"o_orderpriority": "1-URGENT"}, {"o_custkey": {"$lt": 100}}]}]}
    return t("orders").where(constraints.predicate(where)).select("o_orderkey")


@query(rf"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE length({strip('text')}) >= 20),
    bare AS (SELECT doc_id, pos, {strip('line')} AS line FROM lines) SELECT doc_id, count(DISTINCT line) FILTER (line <> '') AS n_lines FROM bare GROUP BY doc_id HAVING count(DISTINCT line) FILTER (line <> '') > 3""")
def distinct_lines(t):
    """Documents of more than three distinct lines."""
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), f.strip), lambda x: x != ""))
    return t("documents").where(F.length(f.strip(F.col("text"))) >= 20).select("doc_id", F.size(lines).cast("long").alias("n_lines")).where("n_lines > 3")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, isodow(ts)::INTEGER AS weekday, date_diff('day', DATE '2023-12-25', ts::DATE)::INTEGER AS days FROM events")
def date_tool(t):
    at = F.col("ts").cast("timestamp")
    return t("events").select("event_id", *[c.alias(n) for n, c in tools.date_parts(at).items()], tools.days_between(F.lit("2023-12-25"), F.to_date(at)).alias("days"))


@query("SELECT event_id, round((event_id % 7 + 2) * 3.5::DOUBLE - sqrt((event_id % 9)::DOUBLE), 6) AS value FROM events")
def calculator(t):
    expression = F.format_string("(%d + 2) * 3.5 - sqrt(%d)", F.col("event_id") % 7, F.col("event_id") % 9)
    return t("events").select("event_id", F.round(tools.calculated(expression), 6).alias("value"))


@query("""WITH c AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS a FROM conversations GROUP BY conv_id), n AS (SELECT conv_id, a, list_sum(list_transform(a, lambda x: length(x))) AS s,
      list_sum(list_transform(a, lambda x: least(600, length(x)))) AS s1, list_sum(list_transform(a, lambda x: least(300, length(x)))) AS s2, list_sum(list_transform(a, lambda x: least(150, length(x)))) AS s3, list_sum(list_transform(a, lambda x: least(60, length(x)))) AS s4,
      len(list_filter(range(1, len(a) + 1), lambda i: list_sum(list_transform(a[1:i], lambda x: least(60, length(x)))) <= 700)) AS fit FROM c)
    SELECT conv_id, array_to_string(CASE WHEN s <= 700 THEN a WHEN s1 <= 700 THEN list_transform(a, lambda x: x[1:600]) WHEN s2 <= 700 THEN list_transform(a, lambda x: x[1:300]) WHEN s3 <= 700 THEN list_transform(a, lambda x: x[1:150])
      WHEN s4 <= 700 THEN list_transform(a, lambda x: x[1:60]) ELSE list_transform(a, lambda x: x[1:60])[1:greatest(1, fit)] END, '|') AS evidence FROM n""")
def evidence_shortened(t):
    texts = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("a"))
    return texts.select("conv_id", F.array_join(tools.shortened(F.transform("a", lambda x: x["text"]), 700), "|").alias("evidence"))
