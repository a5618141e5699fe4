"""Queries of the evaluation and monitoring operators. A vector is relevant to a query with its label, a document to a benchmark
item of which it holds a piece."""

from pyspark.sql import functions as F

from corvine.operators import evaluation as e
from corvine.operators import retrieval as r
from corvine.operators import texts
from corvine.operators.registry import query
from corvine.plans.retrieval import BM25, COSINES, cosines, fused_sql, pools
from corvine.plans.text import MATCHES
from corvine.sources.folders import written

#: Metrics from ranked (query_id, id, place) and relevant (query_id, id), by `groups`.
METRICS = """once AS (SELECT {g} query_id, id, min(place) AS p FROM ranked GROUP BY ALL), first_places AS (SELECT {g} query_id, id, row_number() OVER (PARTITION BY {g} query_id ORDER BY p, id) AS place FROM once),
    ks AS (SELECT unnest([{ks}]) AS k), queries AS (SELECT {g} q.query_id, (SELECT count(*) FROM relevant r WHERE r.query_id = q.query_id) AS n FROM (SELECT {g} query_id FROM ranked UNION SELECT {g} query_id FROM relevant {groups}) q),
    hits AS (SELECT {g} query_id, place FROM first_places JOIN relevant USING (query_id, id)),
    per_query AS (SELECT {qg} q.query_id, k, n, count(place) AS found, min(place) AS first, coalesce(sum(1 / log2(place + 1)), 0) AS gain FROM queries q CROSS JOIN ks LEFT JOIN hits h ON {on} h.query_id = q.query_id AND place <= k GROUP BY ALL),
    scored AS (SELECT *, (found > 0)::DOUBLE AS hit, CASE WHEN n > 0 THEN found / n ELSE 0 END AS rec, coalesce(1 / first, 0) AS rr, CASE WHEN n > 0 THEN gain / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))) END AS nd FROM per_query)
    SELECT {g} k, count(*) AS n_queries, round(avg(hit), 6) AS hit_rate, round(avg(rec), 6) AS recall, round(avg(rr), 6) AS mrr, round(coalesce(avg(nd), 0), 6) AS ndcg FROM scored GROUP BY {g} k"""


@query(f"""WITH {COSINES}, ranked AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM cosines QUALIFY place <= 20), relevant AS (SELECT label AS query_id, vec_id AS id FROM embeddings),
    {METRICS.format(g='', qg='', on='', groups='', ks='1, 3, 5, 10')}""")
def retrieval_metrics_at_k(t):
    ranked = written(r.best(cosines(t, 20), 20, key="vec_id", rank="place").select("query_id", F.col("vec_id").alias("id"), "place"), "ranked")
    return e.metrics(e.at_k(ranked, t("embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id")), [1, 3, 5, 10]))


ALPHAS = [0.0, 0.5, 0.7, 1.0]


def _sweep_sql():
    runs = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, query_id, id, place FROM (WITH {fused_sql(5, a)} SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM fused)" for a in ALPHAS)
    return f"""WITH {BM25}, {MATCHES}, relevant AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM (SELECT doc_id, replace(replace(text, chr(10), ''), ' ', '') AS t FROM documents) JOIN pieces ON contains(t, piece) WHERE length(piece) = 30),
    ranked AS ({runs}), {METRICS.format(g='alpha, ', qg='q.alpha, ', on='h.alpha = q.alpha AND ', groups=', (SELECT unnest([' + ', '.join(map(str, ALPHAS)) + '])::DOUBLE AS alpha)', ks='3, 5')}"""


@query(_sweep_sql())
def alpha_sweep(t):
    """Fusion weights, each measured against the documents that hold a piece of the item."""
    # the metrics read both tables several times: what they hold is looked for in the documents once
    relevant = written(texts.contents(t("documents"), t("benchmark"), "doc_id", "item_id").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id")), "relevant")
    weights = t.spark.createDataFrame([(a,) for a in ALPHAS], "alpha double")
    # the pools are searched once; a question with a weight is a query of its own
    lexical, vector = (p.crossJoin(F.broadcast(weights)).withColumn("query_id", F.struct("query_id", "alpha")).drop("alpha") for p in pools(t, 10))
    ranked = written(r.best(r.fuse(lexical, vector, "doc_id", 5, F.col("query_id.alpha")), 5, key="doc_id", rank="place").select("query_id", F.col("doc_id").alias("id"), "place"), "ranked")
    wanted = relevant.crossJoin(F.broadcast(weights)).select(F.struct("query_id", "alpha").alias("query_id"), "id")
    return e.metrics(e.at_k(ranked, wanted, [3, 5]).withColumn("alpha", F.col("query_id.alpha")), "alpha")


@query(f"""WITH {COSINES}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM cosines QUALIFY n <= 10), running AS (SELECT query_id, label = query_id AS rel, sum((label = query_id)::INTEGER) OVER (PARTITION BY query_id ORDER BY n) / n AS p FROM near)
    SELECT query_id, round(coalesce(sum(p) FILTER (rel), 0) / count(*), 6) AS ap FROM running GROUP BY query_id""")
def context_precision_ap(t):
    near = r.best(cosines(t, 10), 10, key="vec_id", rank="place").join(t("embeddings").select("vec_id", "label"), "vec_id")
    return e.average_precision(near.select("query_id", "place", (F.col("label") == F.col("query_id")).alias("relevant")))


@query("""WITH r AS (SELECT toxic AS e, 1 - quality AS p FROM labels), c AS (SELECT class, count(*) FILTER (e = class AND p = class) AS tp, count(*) FILTER (e = class) AS support, count(*) FILTER (p = class) AS said FROM r, (SELECT DISTINCT unnest([toxic, 1 - quality]) AS class FROM labels) GROUP BY class),
    m AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM c)
    SELECT class, round(pr, 4) AS "precision", round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1, support, (SELECT round(avg((e = p)::INTEGER), 4) FROM r) AS accuracy FROM m""")
def classification_prf(t):
    return e.precision_recall(t("labels").select("toxic", (1 - F.col("quality")).alias("said")), "toxic", "said")


LAST200 = """WITH kept AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200)
    SELECT event_type, count(*) AS count, round(avg(value), 6) AS avg_value, round(avg((value < 5)::INTEGER), 4) AS low_rate, round(CASE WHEN count(*) >= 20 THEN quantile_disc(value, 0.95) ELSE max(value) END, 4) AS p95_value FROM kept GROUP BY event_type"""


@query(LAST200)
def monitor_last200(t):
    rows = t("events").withColumn("low", F.col("value") < 5)
    return e.last_window(rows, "event_type", [F.desc("ts"), F.desc("event_id")], 200, ["value"], ["low"], "value")


@query("SELECT event_type, le, n, sum FROM (SELECT event_type, round(sum(value), 4) AS sum, unnest([{}]) AS x FROM events GROUP BY event_type), (SELECT unnest(x))".format(", ".join(f"{{'le': '{b}', 'n': count(*) FILTER (value <= {b})}}" for b in e.LATENCY_BUCKETS) + ", {'le': '+Inf', 'n': count(*)}").replace("(SELECT unnest(x))", "(SELECT x.le AS le, x.n AS n)"))
def latency_histogram(t):
    return e.histogram(t("events"), "event_type", "value", e.LATENCY_BUCKETS)


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_window_agg(t):
    return t("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("""SELECT d AS dimension, round(avg(s), 2) AS avg, min(s) AS min, max(s) AS max, count(s) AS count, any_value(total) AS total, any_value(pr) AS parse_rate, any_value(h) AS hallucination_rate FROM (
    SELECT unnest(['quality', 'toxic']) AS d, unnest([quality, toxic])::DOUBLE AS s FROM labels), (SELECT count(*) AS total, round(count(toxic) / count(*), 4) AS pr, round(avg((toxic <= 0)::INTEGER), 4) AS h FROM labels) GROUP BY d""")
def judge_summary(t):
    return e.judge_summary(t("labels"), ["quality", "toxic"], "toxic", least=0)


@query("""WITH m AS (SELECT d AS dimension, round(coalesce(avg(s) FILTER (a = 'view'), 0), 2) AS first, round(coalesce(avg(s) FILTER (a = 'click'), 0), 2) AS second FROM (SELECT event_type AS a, unnest(['value', 'hour']) AS d, unnest([value, hour(ts)::DOUBLE]) AS s FROM events) GROUP BY d)
    SELECT *, round(first - second, 2) AS delta, CASE WHEN round(first - second, 2) > 0.2 THEN 'improved' WHEN round(first - second, 2) < -0.2 THEN 'degraded' ELSE 'same' END AS verdict FROM m""")
def group_comparison(t):
    return e.compare(t("events").withColumn("hour", F.hour("ts")), "event_type", "view", "click", ["value", "hour"])


@query()
def bootstrap_ci(t):
    return e.bootstrap(t("events").select("event_type", "value"), "event_type", "value", rounds=200)


@query("""WITH RECURSIVE s AS (SELECT event_id // 10 AS trace_id, event_id AS span_id, CASE WHEN event_id % 10 > 0 THEN event_id // 10 * 10 + event_id % 10 // 3 END AS parent, event_type AS kind, value AS ms, length(props) AS tokens FROM events),
    down AS (SELECT trace_id, span_id, 1 AS depth FROM s WHERE parent IS NULL UNION ALL SELECT s.trace_id, s.span_id, depth + 1 FROM s JOIN down d ON s.trace_id = d.trace_id AND s.parent = d.span_id)
    SELECT trace_id, count(*) AS n_spans, count(*) FILTER (kind = 'error') AS n_errors, round(sum(ms), 4) AS total_ms, sum(tokens)::BIGINT AS tokens, (SELECT max(depth) FROM down d WHERE d.trace_id = s.trace_id) AS depth FROM s GROUP BY trace_id""")
def trace_totals(t):
    place = F.col("event_id") % 10
    trace = F.floor(F.col("event_id") / 10)
    spans = t("events").select(trace.alias("trace_id"), F.col("event_id").alias("span_id"), F.when(place > 0, trace * 10 + F.floor(place / 3)).alias("parent_span_id"), F.col("event_type").alias("kind"), F.col("value").alias("ms"), F.length("props").alias("tokens"))
    return e.span_totals(spans)




@query("""WITH RECURSIVE s AS (SELECT event_id // 50 AS trace_id, event_id AS span_id, CASE WHEN event_id % 50 > 0 THEN greatest(event_id - event_id % 50, event_id - 1 - (event_id % 50) % 2) END AS parent, event_type AS kind, value AS ms, length(props) AS tokens FROM events),
    down AS (SELECT trace_id, span_id, 1 AS depth FROM s WHERE parent IS NULL UNION ALL SELECT s.trace_id, s.span_id, depth + 1 FROM s JOIN down d ON s.trace_id = d.trace_id AND s.parent = d.span_id)
    SELECT trace_id, count(*) AS n_spans, count(*) FILTER (kind = 'error') AS n_errors, round(sum(ms), 4) AS total_ms, sum(tokens)::BIGINT AS tokens, (SELECT max(depth) FROM down d WHERE d.trace_id = s.trace_id) AS depth FROM s GROUP BY trace_id""")
def trace_totals_deep(t):
    """Spans that nest more than twenty deep."""
    place = F.col("event_id") % 50
    parent = F.when(place > 0, F.greatest(F.col("event_id") - place, F.col("event_id") - 1 - place % 2))
    spans = t("events").select(F.floor(F.col("event_id") / 50).alias("trace_id"), F.col("event_id").alias("span_id"), parent.alias("parent_span_id"), F.col("event_type").alias("kind"), F.col("value").alias("ms"), F.length("props").alias("tokens"))
    return e.span_totals(spans)


_STEPS = """CASE WHEN tr % 5 = 1 AND k = 2 THEN 'done' WHEN tr % 4 = 3 AND k IN (1, 3) THEN 'error' ELSE CASE k WHEN 0 THEN 'planning' WHEN 1 THEN 'tool_calling' WHEN 2 THEN 'reflecting' WHEN 3 THEN 'responding' ELSE 'done' END END"""


@query(f"""WITH e AS (SELECT event_id, event_id // 6 AS tr, event_id % 6 AS k FROM events), s AS (SELECT event_id, tr, {_STEPS} AS st FROM e WHERE NOT (tr % 7 = 2 AND k >= 3) AND (k < 5 OR tr % 3 = 0)),
    allowed AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, follow in e.TRANSITIONS.items() for b in follow)}) v(a, b)),
    l AS (SELECT tr, st, row_number() OVER w AS n, coalesce(lag(st) OVER w, 'idle') AS before FROM s WINDOW w AS (PARTITION BY tr ORDER BY event_id)),
    m AS (SELECT l.*, allowed.a IS NULL AS wrong FROM l LEFT JOIN allowed ON before = a AND st = b)
    SELECT tr AS trace_id, count(*) AS n_steps, count(*) FILTER (wrong) AS n_illegal, min(n) FILTER (wrong)::INTEGER AS first_illegal, arg_min(before, n) FILTER (wrong) AS from_state, arg_min(st, n) FILTER (wrong) AS to_state, arg_max(st, n) AS last_state,
      count(*) FILTER (wrong) = 0 AND arg_max(st, n) = 'done' AS finished FROM m GROUP BY tr""")
def trace_transitions(t):
    """Runs of an assistant made of events by rule: legal ones, ones with illegal steps, unfinished ones."""
    rows = t("events").select("event_id", F.floor(F.col("event_id") / 6).alias("tr"), (F.col("event_id") % 6).alias("k"))
    plain = F.when(F.col("k") == 0, "planning").when(F.col("k") == 1, "tool_calling").when(F.col("k") == 2, "reflecting").when(F.col("k") == 3, "responding").otherwise("done")
    state = F.when((F.col("tr") % 5 == 1) & (F.col("k") == 2), "done").when((F.col("tr") % 4 == 3) & F.col("k").isin(1, 3), "error").otherwise(plain)
    steps = rows.where("NOT (tr % 7 = 2 AND k >= 3) AND (k < 5 OR tr % 3 = 0)").select(F.col("tr").alias("trace_id"), "event_id", state.alias("state"))
    return e.checked_traces(steps, "trace_id", ["event_id"], "state")
