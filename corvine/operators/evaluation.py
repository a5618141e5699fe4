"""Retrieval quality, classification quality, and run-time monitoring."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.operators import trees


def at_k(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, k, hit, recall, rr, ndcg of each query.

    ranked: query_id, id, place (from 1); an id counts at its first place only. relevant: query_id, id. Queries are those
    of both tables; one without relevant ids has no recall, rr or ndcg (null ndcg leaves it out of that average, the
    others count 0).
    """
    once = ranked.groupBy("query_id", "id").agg(F.min("place").alias("place"))
    once = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id")))
    wanted = relevant.select("query_id", "id").distinct()
    hits = once.join(wanted, ["query_id", "id"])
    total = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    queries = ranked.select("query_id").union(relevant.select("query_id")).distinct().join(total, "query_id", "left")
    cuts = queries.select("query_id", "n", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    met = cuts.join(hits.select("query_id", "place"), "query_id", "left").withColumn("in", F.col("place") <= F.col("k"))
    scored = met.groupBy("query_id", "k", "n").agg(F.count_if("in").alias("found"), F.min(F.when(F.col("in"), F.col("place"))).alias("first"), F.sum(F.when(F.col("in"), 1 / F.log2(F.col("place") + 1))).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.select(
        "query_id", "k", (F.col("found") > 0).cast("double").alias("hit"), zero(F.col("found") / F.col("n")).alias("recall"), zero(1 / F.col("first")).alias("rr"),
        F.when(F.col("n") > 0, zero(F.col("gain")) / ideal).alias("ndcg"),
    )


def metrics(per_query: DataFrame, *groups: str) -> DataFrame:
    """Averages over the queries of at_k, by k (and by further columns)."""
    named = {"hit_rate": "hit", "recall": "recall", "mrr": "rr", "ndcg": "ndcg"}
    return per_query.groupBy(*groups, "k").agg(F.count("*").alias("n_queries"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for n, c in named.items()])


def best_setting(scores: DataFrame, parameter: str, by: str) -> DataFrame:
    """The value of a parameter with the best score; of several the least."""
    return scores.agg(F.max(F.struct(F.col(by), (-F.col(parameter)).alias("m"))).alias("b")).select((-F.col("b.m")).alias(parameter), F.col(f"b.{by}").alias(by))


def average_precision(judged: DataFrame, denominator: str = "listed") -> DataFrame:
    """query_id, ap from query_id, place (from 1), relevant (boolean): sum of the precisions at relevant places, divided by the
    length of the list, or by the number of relevant ones with denominator="relevant"."""
    so_far = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    marked = judged.withColumn("__r", F.col("relevant").cast("int")).withColumn("__p", F.sum("__r").over(so_far) / F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    over = F.count("*") if denominator == "listed" else F.sum("__r")
    return marked.groupBy("query_id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("__p") * F.col("__r")), over), F.lit(0.0)), 6).alias("ap"))


def precision_recall(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support of each class that is expected or predicted, and accuracy of all rows: one count of
    (expected, predicted) pairs, then sums over its few cells."""
    cells = rows.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("e").alias("class"), F.lit(True).alias("wanted")), F.struct(F.col("p").alias("class"), F.lit(False).alias("wanted")))).alias("s"), "e", "p", "n").select("s.*", "e", "p", "n")
    right = F.col("e").eqNullSafe(F.col("p"))
    by_class = sides.groupBy("class").agg(F.sum(F.when(right & F.col("wanted"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("wanted"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("wanted"), F.col("n")).otherwise(0)).alias("said"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("support"))
    accuracy = cells.agg(share(F.sum(F.when(right, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return by_class.crossJoin(F.broadcast(accuracy)).select("class", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(share(2 * precision * recall, precision + recall), 4).alias("f1"), "support", F.round("accuracy", 4).alias("accuracy"))


def bootstrap(rows: DataFrame, group: str, value: str, rounds: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """group, n, mean, ci_lower, ci_upper: percentile interval of the mean over resamples.

    A resample weighs each row by a Poisson(1) count; of m equal rows, which are counted first, by a Poisson(m) count. Counts are drawn from a hash of the row, so
    that they are the same at every run. A task adds up all resamples' sums as it reads, one array a group; no row is multiplied. Fewer than
    three values: the interval is the mean.
    """
    equal = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v"), F.xxhash64(*rows.columns).alias("__id")).agg(F.count("*").alias("__m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None

        def given() -> pa.RecordBatch:
            arrays = [pa.array(list(sums), kind), *(pa.array([list(s[i]) for s in sums.values()], pa.list_(pa.float64())) for i in (0, 1))]
            return pa.RecordBatch.from_arrays(arrays, names=["__g", "w", "wv"])

        for batch in batches:
            kind = batch.column("__g").type
            for own, v, h, m in zip(*(batch.column(c).to_pylist() for c in ("__g", "__v", "__id", "__m")), strict=True):
                drawn = np.random.Generator(np.random.Philox(key=[seed % 2**64, h % 2**64])).poisson(m, rounds)
                if own not in sums:
                    if len(sums) >= 1000:
                        yield given()
                        sums.clear()
                    sums[own] = [np.zeros(rounds), np.zeros(rounds)]
                sums[own][0] += drawn
                sums[own][1] += drawn * v
        if sums:
            yield given()

    drawn = equal.mapInArrow(run, f"__g {dict(equal.dtypes)['__g']}, w array<double>, wv array<double>")
    long = drawn.select("__g", F.posexplode(F.arrays_zip("w", "wv")).alias("__r", "x")).groupBy("__g", "__r").agg(F.sum("x.w").alias("w"), F.sum("x.wv").alias("wv"))
    means = long.select("__g", F.try_divide("wv", "w").alias("m"))
    tail = (1 - confidence) / 2
    cut = means.groupBy(F.col("__g").alias("__h")).agg(F.expr(f"percentile_disc({tail}) WITHIN GROUP (ORDER BY m)").alias("lo"), F.expr(f"percentile_disc({1 - tail}) WITHIN GROUP (ORDER BY m)").alias("hi"))
    plain = equal.groupBy("__g").agg(F.sum("__m").alias("n"), F.try_divide(F.sum(F.col("__v") * F.col("__m")), F.sum("__m")).alias("mean"))
    few = F.col("n") < 3
    return plain.join(cut, F.col("__g").eqNullSafe(F.col("__h"))).select(F.col("__g").alias(group), "n", F.round("mean", 4).alias("mean"), F.round(F.when(few, F.col("mean")).otherwise(F.col("lo")), 4).alias("ci_lower"), F.round(F.when(few, F.col("mean")).otherwise(F.col("hi")), 4).alias("ci_upper"))


def judge_summary(scores: DataFrame, dimensions: list[str], hallucination: str, least: int = 2) -> DataFrame:
    """dimension, avg, min, max, count of each score column, with total, parse_rate and hallucination_rate (share of scores of
    `least` or below among those given) of all rows."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("s")) for d in dimensions])).alias("x")).select("x.*")
    by_dimension = long.groupBy("dimension").agg(F.round(F.avg("s"), 2).alias("avg"), F.min("s").alias("min"), F.max("s").alias("max"), F.count("s").alias("count"))
    whole = scores.agg(F.count("*").alias("total"), F.round(F.count(hallucination) / F.count("*"), 4).alias("parse_rate"), F.round(F.coalesce(F.try_divide(F.count_if(F.col(hallucination) <= least), F.count(hallucination)), F.lit(0.0)), 4).alias("hallucination_rate"))
    return by_dimension.crossJoin(F.broadcast(whole))


def batch_averages(scored: DataFrame, scores: list[str], failed: Column) -> DataFrame:
    """total, succeeded, failed, and avg_ of each score over the rows that didn't fail, rounded to four places; null without any such row. A null of `failed` is a failure."""
    bad = F.coalesce(failed, F.lit(True))
    good = lambda name: F.round(F.avg(F.when(~bad, F.col(name))), 4).alias(f"avg_{name}")
    return scored.agg(F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), *map(good, scores))


def compare(rows: DataFrame, arm: str, first, second, dimensions: list[str], margin: float = 0.2) -> DataFrame:
    """dimension, first, second, delta, verdict (improved, degraded, same) of the averages of two arms."""
    long = rows.select(F.col(arm).alias("__a"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("s")) for d in dimensions])).alias("x")).select("__a", "x.*")
    mean = lambda value: F.round(F.coalesce(F.avg(F.when(F.col("__a") == value, F.col("s"))), F.lit(0.0)), 2)
    met = long.groupBy("dimension").agg(mean(first).alias("first"), mean(second).alias("second"))
    delta = F.round(F.col("first") - F.col("second"), 2)
    return met.withColumn("delta", delta).withColumn("verdict", F.when(F.col("delta") > margin, "improved").when(F.col("delta") < -margin, "degraded").otherwise("same"))


# ---- monitoring

def last_window(rows: DataFrame, group: str, order: list[Column], n: int, means: list[str], flags: list[str], total: str) -> DataFrame:
    """Of the last n rows of each group: count, averages, rates of boolean columns, p95 (nearest rank; the largest below 20 rows) of
    `total`. order is newest first; the cut to n rows comes before any aggregate."""
    kept = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n)
    p95 = F.when(F.count("*") >= 20, F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {total})")).otherwise(F.max(total))
    return kept.groupBy(group).agg(F.count("*").alias("count"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in means], *[F.round(F.avg(F.col(c).cast("int")), 4).alias(f"{c}_rate") for c in flags], F.round(p95, 4).alias(f"p95_{total}"))


# Upper bounds of the histograms' buckets.
LATENCY_BUCKETS = [10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0]
RATIO_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def histogram(rows: DataFrame, group: str, value: str, buckets: list[float]) -> DataFrame:
    """group, le, n (rows with a value of le at most; the last bucket, infinity, has all), sum. One pass of conditional counts."""
    bounds = [*buckets, float("inf")]
    counted = rows.groupBy(group).agg(F.round(F.sum(value), 4).alias("sum"), *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return counted.select(group, "sum", F.explode(F.array(*[F.struct(F.lit(str(b) if b < float("inf") else "+Inf").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select(group, "x.le", "x.n", "sum")


def span_totals(spans: DataFrame) -> DataFrame:
    """trace_id, n_spans, n_errors, total_ms, tokens, depth from trace_id, span_id, parent_span_id, kind, ms, tokens: sums over a trace's
    spans, and how deep those nest that lead to a span without a parent (null if there is none)."""
    sums = spans.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.count_if(F.col("kind") == "error").alias("n_errors"), F.round(F.sum("ms"), 4).alias("total_ms"), F.sum("tokens").alias("tokens"))
    tree = spans.select(F.struct("trace_id", "span_id").alias("k"), F.when(F.col("parent_span_id").isNotNull(), F.struct("trace_id", F.col("parent_span_id").alias("span_id"))).alias("p"))
    deepest = trees.depths(tree, "k", "p").groupBy("node.trace_id").agg(F.max("depth").alias("depth"))
    return sums.join(deepest, "trace_id", "left")


# Which state of an assistant's run may follow which.
TRANSITIONS = {"idle": ["planning"], "planning": ["tool_calling", "responding", "error"], "tool_calling": ["reflecting", "error"], "reflecting": ["tool_calling", "responding", "error"], "responding": ["done"], "done": [], "error": ["done"]}


def checked_traces(steps: DataFrame, trace: str, order: list[str], state: str, allowed: dict[str, list[str]] = TRANSITIONS, start: str = "idle", ends: tuple[str, ...] = ("done",)) -> DataFrame:
    """trace, n_steps, n_illegal, first_illegal (its place from 1), from_state, to_state (of that step), last_state, finished of each trace.

    A step is the state that a trace goes to; before its first one it is in start. A step that may not follow the state before is illegal, and the trace goes on from it;
    a null or unknown state may follow nothing. finished: no step is illegal and the last state is one of ends. Ties of order are broken by the state.
    """
    spark = steps.sparkSession
    pairs = spark.createDataFrame([(a, b) for a, follow in allowed.items() for b in follow], "__from string, __to string")
    within = Window.partitionBy(trace).orderBy(*order, state)
    placed = steps.select(trace, F.col(state).alias("__s"), F.row_number().over(within).cast("int").alias("__n"), F.lag(F.struct(F.col(state).alias("s"))).over(within).alias("__l"))
    moved = placed.withColumn("__b", F.when(F.col("__l").isNull(), F.lit(start)).otherwise(F.col("__l.s")))
    met = moved.join(F.broadcast(pairs), (F.col("__b") == F.col("__from")) & (F.col("__s") == F.col("__to")), "left")  # a few pairs
    wrong = F.col("__to").isNull()
    found = met.groupBy(trace).agg(F.count("*").alias("n_steps"), F.count_if(wrong).alias("n_illegal"), F.min(F.when(wrong, F.struct(F.col("__n").alias("n"), F.col("__b").alias("b"), F.col("__s").alias("s")))).alias("__w"), F.max(F.struct("__n", "__s")).alias("__e"))
    return found.select(trace, "n_steps", "n_illegal", F.col("__w.n").alias("first_illegal"), F.col("__w.b").alias("from_state"), F.col("__w.s").alias("to_state"), F.col("__e.__s").alias("last_state"), (F.col("__w").isNull() & F.coalesce(F.col("__e.__s").isin(list(ends)), F.lit(False))).alias("finished"))
