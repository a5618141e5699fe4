"""The registered query of each operator, and DuckDB SQL for those that SQL expresses."""

import os
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import ann, bytebpe, decontam, langid, licenses, linededup, periods, quotes, repair, sentencepiece, simhash, toxicity, warc
from corvine.llm.common import written
from corvine.sources.tables import spread, table

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")


def op1_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, folder, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(spread(table(spark, folder, "documents")))


def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(spread(table(spark, folder, "documents")), table(spark, folder, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(spread(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(spread(table(spark, folder, "documents")))


def op7_quotation_links(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, in which no message quotes: of three turns in a row the second quotes the first, and the third
    both, the first as quoted by the second (level 2)."""
    messages = table(spark, folder, "conversations")
    said = lambda k: messages.where("turn IS NOT NULL").groupBy("conv_id", (F.col("turn") + k).alias("turn")).agg(F.min("text").alias(f"said{k}"))
    near = lambda k: said(k).withColumnsRenamed({"conv_id": f"c{k}", "turn": f"t{k}"})
    same = lambda k: F.col("conv_id").eqNullSafe(F.col(f"c{k}")) & (F.col("turn") == F.col(f"t{k}"))
    met = messages.join(near(1), same(1), "left").join(near(2), same(2), "left")
    quote = lambda mark, c: F.concat(F.lit(mark), F.replace(c, F.lit("\n"), F.lit(f"\n{mark}")))
    one, two = F.concat(quote("> ", F.col("said1")), F.lit("\n\n"), "text"), F.concat(quote("> > ", F.col("said2")), F.lit("\n"), quote("> ", F.col("said1")), F.lit("\n\n"), "text")
    text = F.when(F.pmod("turn", F.lit(3)) == 1, F.coalesce(one, "text")).when(F.pmod("turn", F.lit(3)) == 2, F.coalesce(two, "text")).otherwise(F.col("text"))
    return quotes.conversations(met.select("conv_id", "turn", "role", text.alias("text")))


def op8_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as archives, against a second copy that is written and read again and is damaged by rule: some
    pages are longer by a byte, some others are lost, so that what lies behind them moves."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    changed, lost = F.col("page_id") % 97 == 13, F.coalesce(F.col("page_id") % 193 == 57, F.lit(False))
    copy = written(pages.where(~lost).withColumn("html", F.when(changed, F.concat(F.coalesce("html", F.lit("")), F.lit("?"))).otherwise(F.col("html"))))
    return warc.audit(warc.catalogued(pages), warc.catalogued(copy))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.digest(table(spark, folder, "documents"))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece.round_trip(spread(table(spark, folder, "documents")), sentencepiece.read_model(f"{TOKENIZERS}/piece_bpe_32k.model"))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of every tenth document by the checksum h of its id: words that repeat with a period from one word on, both given by h."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    start = g % len(words)
    period = 1 + (len(words) - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(len(words) - start)]


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, of which every tenth ends in words that repeat."""
    return periods.digest(spread(table(spark, folder, "documents")), repeated_tail)


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bytebpe.digest(spread(table(spark, folder, "documents")), ranks, public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged by rule, and repaired."""
    messages = table(spark, folder, "conversations")
    return repair.audited(repair.damaged(messages), messages)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language": op6_language,
    "op7_quotation_links": op7_quotation_links,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_line_dedup": op9_line_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}



def _with(way: str, cost: int | str, letter: str) -> str:
    """SQL: a way (nine digits of cost, then the audit) with an edit before it."""
    return f"lpad((left({way}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({way}, 10)"


def _edits(state: int, given: int, kept: str) -> str:
    """SQL: the best of deleting, reroling and keeping a row in a state; given: the state behind a rerole, kept: the way behind a kept row."""
    stays = "CASE WHEN truncated THEN 5 ELSE 0 END"
    return f"least({_with(f'e{state}', 2, 'D')}, CASE WHEN NOT gone THEN {_with(f'e{given}', f'1 + {stays}', 'R')} END, CASE WHEN NOT gone THEN {_with(kept, stays, 'K')} END)"


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op7_quotation_links": r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE turn IS NOT NULL GROUP BY ALL),
planted AS (
  SELECT c.conv_id, c.turn, c.role, CASE
    WHEN ((c.turn % 3) + 3) % 3 = 1 THEN coalesce('> ' || replace(p.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || c.text, c.text)
    WHEN ((c.turn % 3) + 3) % 3 = 2 THEN coalesce('> > ' || replace(q.text, chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(p.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || c.text, c.text)
    ELSE c.text END AS text
  FROM conversations c LEFT JOIN said p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.turn + 1 = c.turn
  LEFT JOIN said q ON q.conv_id IS NOT DISTINCT FROM c.conv_id AND q.turn + 2 = c.turn),
m AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER w AS place, lag(turn) OVER w AS before
  FROM planted WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
raw AS (
  SELECT conv_id, place, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM m),
lines AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         trim(lower(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '\s+', ' ', 'g'))) AS words FROM raw),
filled AS (SELECT * FROM lines WHERE words <> ''),
broken AS (
  SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(level) OVER w = level THEN 0 ELSE 1 END AS new
  FROM filled WINDOW w AS (PARTITION BY conv_id, place ORDER BY pos)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, place ORDER BY pos) AS run FROM broken),
units AS (
  SELECT conv_id, place, level, words FROM filled
  UNION SELECT conv_id, place, level, string_agg(words, ' ' ORDER BY pos) FROM runs GROUP BY conv_id, place, level, run),
links AS (
  SELECT u.conv_id, u.place, u.level, u.words, max(f.place) AS source
  FROM units u JOIN units f ON f.conv_id IS NOT DISTINCT FROM u.conv_id AND f.words = u.words AND f.level = 0 AND f.place < u.place
  WHERE u.level > 0 GROUP BY ALL),
weighed AS (SELECT conv_id, place, level, source, sum(length(words)) AS weight, count(*) AS n FROM links GROUP BY ALL),
best AS (
  SELECT conv_id, place, source, level, sum(n) OVER (PARTITION BY conv_id, place) AS n_linked FROM weighed
  QUALIFY row_number() OVER (PARTITION BY conv_id, place ORDER BY level, weight DESC, source DESC) = 1),
up AS (SELECT m.conv_id, m.place, coalesce(b.source, m.place - 1) AS parent FROM m LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.place = m.place),
deep AS (
  SELECT conv_id, place, 0::BIGINT AS depth FROM up WHERE parent = 0
  UNION ALL SELECT u.conv_id, u.place, d.depth + 1 FROM up u JOIN deep d ON d.conv_id IS NOT DISTINCT FROM u.conv_id AND d.place = u.parent),
shown AS (
  SELECT l.conv_id, l.place, count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level,
         string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT introduces) AS own
  FROM (SELECT *, regexp_matches(line, '(?i)^\s*(on|am|le|el)\s.*(wrote|schrieb|écrit|escribió).*:\s*$')
               AND coalesce(lead(level) OVER (PARTITION BY conv_id, place ORDER BY pos) > 0, false) AS introduces FROM lines) l GROUP BY l.conv_id, l.place)
SELECT m.conv_id, m.turn, m.role, m.place, CASE WHEN b.place IS NULL THEN m.before ELSE p.turn END AS reply_to, d.depth,
       CASE WHEN m.text IS NOT NULL THEN trim(coalesce(s.own, ''), chr(10)) END AS own_text,
       coalesce(s.n_quoted, 0) AS n_quoted, coalesce(s.max_level, 0) AS max_level, coalesce(b.n_linked, 0)::BIGINT AS n_linked, coalesce(b.level, 0) AS linked_level
FROM m LEFT JOIN shown s ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.place = m.place
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.place = m.place
LEFT JOIN m p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.place = b.source
JOIN deep d ON d.conv_id IS NOT DISTINCT FROM m.conv_id AND d.place = m.place""",
    "op8_warc_fixity": """
WITH r AS (
  SELECT page_id, url, page_id // 1000 AS archive, page_id % 193 = 57 AS lost, page_id % 97 = 13 AS changed,
         coalesce(html, '') AS body, coalesce(html, '') || CASE WHEN page_id % 97 = 13 THEN '?' ELSE '' END AS damaged FROM pages),
s AS (
  SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head,
         chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM r),
t AS (SELECT *, head || strlen(body) || gap || body || gap AS x, head || strlen(damaged) || gap || damaged || gap AS y FROM s),
o AS (
  SELECT *, coalesce(sum(strlen(x)) OVER (PARTITION BY archive ORDER BY page_id, url, sha256(x) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_left,
         coalesce(sum(CASE WHEN lost THEN 0 ELSE strlen(y) END) OVER (PARTITION BY archive ORDER BY page_id, url, sha256(y) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_right
  FROM t)
SELECT archive, offset_left, CASE WHEN NOT lost THEN offset_right END AS offset_right, strlen(x) AS length_left, CASE WHEN NOT lost THEN strlen(y) END AS length_right,
       sha256(x) AS digest_left, CASE WHEN NOT lost THEN sha256(y) END AS digest_right, CASE WHEN lost THEN 'missing' ELSE 'changed' END AS status
FROM o WHERE lost OR changed""",
    "op9_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND h.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN held h ON h.key = k.key),
grouped AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept,
         list(pos ORDER BY pos) FILTER (gone) AS p
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256,
       coalesce(array_to_string(list_transform(p, lambda x, i: (x - CASE WHEN i = 1 THEN 0 ELSE p[i - 1] + 1 END)::VARCHAR || ',1'), ','), '') AS keep_runs
FROM grouped""",
    "op13_conversation_repair": f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (
  SELECT conv_id, turn, role, text, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::UBIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::UBIGINT)))) % 20 AS d FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM summed),
placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, trim(text, {_BLANK}) AS bare, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM damaged),
told AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
faults AS (
  SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM told),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
ways AS (
  SELECT conv_id, n + 1 AS i, '000000000' AS e0, '000000010II' AS e1, '000000005I' AS e2, '000000000' AS e3 FROM counted
  UNION ALL
  SELECT conv_id, i, least(b0, {_with("c2", 5, "I")}), least(b1, {_with("c2", 5, "I")}), c2, least(b3, {_with("b2", 5, "I")}) FROM (SELECT *, least(b2, {_with("b3", 5, "I")}) AS c2 FROM (
    SELECT f.conv_id, f.i, {_edits(0, 2, "CASE initial WHEN 's' THEN e1 WHEN 'u' THEN e2 END")} AS b0, {_edits(1, 2, "CASE initial WHEN 'u' THEN e2 END")} AS b1,
           {_edits(2, 3, "CASE initial WHEN 'a' THEN e3 END")} AS b2, {_edits(3, 2, "CASE initial WHEN 'u' THEN e2 END")} AS b3
    FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1))),
best AS (SELECT conv_id, left(e0, 9)::BIGINT AS cost, substr(e0, 10) AS audit FROM ways WHERE i = 1),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(len(string_split(audit, '')))) AS j FROM best WHERE audit <> ''),
steps AS (
  SELECT *, sum((edit <> 'I')::BIGINT) OVER w AS i, sum((edit <> 'D')::BIGINT) OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
rows AS (
  SELECT s.conv_id, s.o, s.edit, f.role, CASE WHEN s.edit <> 'I' THEN f.text ELSE '' END AS text, bool_or(s.o = 1 AND s.edit = 'K' AND f.initial = 's') OVER (PARTITION BY s.conv_id) AS led
  FROM steps s LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i WHERE s.edit <> 'D'),
said AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o % 2 = 1) <> led THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS said FROM rows GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
