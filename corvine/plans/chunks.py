"""Queries of the chunk strategies."""

from pyspark.sql import functions as F

from corvine.functions import sql
from corvine.operators import chunks as c
from corvine.operators.registry import query
from corvine.plans.text import SPACE, strip

_MARKS = ["chr(10) || chr(10)", "chr(10)", "'。'", "'！'", "'？'", "'.'", "'!'", "'?'"]


def fixed_sql(size, overlap, source="documents", key="doc_id", name="fixed"):
    """Chunks (a table of this name) of the texts of a source, by recursion over the starts; the last place of a mark is the first one in the reversed window."""
    window = f"reverse(text[start + 1 : start + {size}])"
    ends = ", ".join(f"CASE WHEN instr({window}, {m}) > 0 AND {size} - instr({window}, {m}) + 1 - length({m}) > {size // 2} THEN start + {size} - instr({window}, {m}) + 1 END" for m in _MARKS)
    end = f"CASE WHEN start + {size} >= n THEN n ELSE coalesce({ends}, start + {size}) END"
    return f"""{name}_cuts AS (SELECT {key}, text, n, start, {end} AS stop FROM (SELECT {key}, text, length(text) AS n, 0 AS start FROM {source} WHERE length(text) > {size})
      UNION ALL SELECT {key}, text, n, start, {end} FROM (SELECT {key}, text, n, greatest(start + 1, stop - {overlap}) AS start FROM {name}_cuts WHERE stop < n)),
    {name}_pieces AS (SELECT {key}, start, {strip('text[start + 1 : stop]')} AS content FROM {name}_cuts UNION ALL SELECT {key}, 0, text FROM {source} WHERE length(text) <= {size} AND {strip('text')} <> ''),
    {name} AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY start) - 1)::INTEGER AS chunk_index, content FROM {name}_pieces WHERE content <> '')"""


FIXED = f"WITH RECURSIVE {fixed_sql(800, 150)} SELECT doc_id, chunk_index, content FROM fixed"


@query(FIXED)
def chunk_fixed(t):
    return c.chunk(t("documents"), "doc_id", strategy="fixed", size=800, overlap=150).select("doc_id", "chunk_index", "content")


SENTENCES = rf"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?\n])[{SPACE}]*', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM documents),
    folded AS (SELECT doc_id, s, 1 AS i, s[1] AS cur, NULL::VARCHAR AS done FROM s WHERE len(s) > 0
      UNION ALL SELECT doc_id, s, i + 1, CASE WHEN length(cur) + length(s[i + 1]) > 800 THEN right(cur, 150) || s[i + 1] ELSE cur || s[i + 1] END, CASE WHEN length(cur) + length(s[i + 1]) > 800 THEN cur END FROM folded WHERE i < len(s)),
    chunks AS (SELECT doc_id, i, done AS content FROM folded WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM folded WHERE i = len(s))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, content FROM chunks"""


@query(SENTENCES)
def chunk_sentence(t):
    return c.chunk(t("documents"), "doc_id", strategy="sentence", size=800, overlap=150).select("doc_id", "chunk_index", "content")


@query(rf"""WITH parts AS (SELECT item_id, text FROM benchmark) SELECT item_id, 0 AS chunk_index, text AS content FROM parts WHERE length(text) <= 4000""")
def chunk_markdown(t):
    """The benchmark's items have no headings and are short: one section each. (Headings are tested on fixtures.)"""
    return c.chunk(t("benchmark"), "item_id", strategy="markdown", size=4000).select("item_id", "chunk_index", "content")


@query(rf"""WITH RECURSIVE raw AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
    told AS (SELECT doc_id, pos, CASE WHEN pos % 10 = 2 THEN '## ' || line ELSE line END AS line, pos % 10 = 2 AND {strip("array_to_string(string_split(text, chr(10))[pos + 1 :], chr(10))")} <> '' AS heads FROM raw),
    placed AS (SELECT *, sum(heads::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS part, max(heads::INTEGER) OVER (PARTITION BY doc_id) AS any_heads FROM told),
    sections AS (SELECT doc_id * 100000 + part AS part_id, CASE WHEN any_value(any_heads) = 1 THEN {strip("string_agg(line, chr(10) ORDER BY pos)")} ELSE string_agg(line, chr(10) ORDER BY pos) END AS text FROM placed GROUP BY doc_id, part),
    {fixed_sql(800, 0, "sections", "part_id")}
    SELECT part_id // 100000 AS doc_id, (row_number() OVER (PARTITION BY part_id // 100000 ORDER BY part_id, chunk_index) - 1)::INTEGER AS chunk_index, content FROM fixed""")
def chunk_markdown_documents(t):
    """Documents with every tenth line made a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 10 == 2, F.concat(F.lit("## "), x)).otherwise(x))
    return c.chunk(t("documents").select("doc_id", F.array_join(lines, "\n").alias("text")), "doc_id", strategy="markdown", size=800).select("doc_id", "chunk_index", "content")


@query(rf"""WITH RECURSIVE bare AS (SELECT doc_id, {strip("text")} AS text FROM documents), {fixed_sql(800, 100, "bare", name="above")},
    parents AS (SELECT doc_id * 100000 + chunk_index AS part_id, content AS text FROM above), {fixed_sql(200, 50, "parents", "part_id")}
    SELECT part_id // 100000 AS doc_id, (part_id % 100000)::INTEGER AS parent_index, chunk_index AS child_index, text AS parent_content, content AS child_content FROM fixed JOIN parents USING (part_id)""")
def chunk_parent_child(t):
    return c.parents_and_children(t("documents"), "doc_id")


@query()
def chunk_semantic(t):
    return c.chunk(t("documents"), "doc_id", strategy="semantic").select("doc_id", "chunk_index", "content")


@query(f"WITH RECURSIVE {fixed_sql(800, 150)} SELECT doc_id, chunk_index, 'Part of: ' || substr(text, 1, 40) || chr(10) || chr(10) || content AS content FROM fixed JOIN documents USING (doc_id)")
def chunk_contextual(t):
    """With a rule in place of the model that describes a chunk."""
    docs = t("documents")
    found = c.chunk(docs, "doc_id", strategy="fixed", size=800, overlap=150)
    return c.in_context(found, docs, "doc_id", lambda head, content: F.concat(F.lit("Part of: "), F.substring(head, 1, 40))).select("doc_id", "chunk_index", "content")


@query(f"""WITH RECURSIVE {fixed_sql(800, 150)}, n AS (SELECT length(content) AS n FROM fixed) SELECT count(*) AS n_chunks, round(avg(n), 4) AS avg_length, min(n)::INTEGER AS min_length, max(n)::INTEGER AS max_length FROM n""")
def chunk_length_stats(t):
    size = F.length("content")
    found = c.chunk(t("documents"), "doc_id", strategy="fixed", size=800, overlap=150)
    return found.agg(F.count("*").alias("n_chunks"), F.round(F.avg(size), 4).alias("avg_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"))


def lateral(t, call):
    """Chunks of all documents by the table function, from SQL."""
    sql.register(t.spark)
    return t.spark.sql(f"SELECT doc_id, chunk_index, content FROM {{docs}}, LATERAL {call}", docs=t("documents"))


@query(FIXED)
def sql_chunk_fixed(t):
    return lateral(t, "chunk(text, 'fixed', 800, 150)")


@query(SENTENCES)
def sql_chunk_sentence(t):
    return lateral(t, "chunk(text, strategy => 'sentence', size => 800, overlap => 150)")
