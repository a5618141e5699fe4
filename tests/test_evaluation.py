import math
import random

from pyspark.sql import functions as F

from corvine.operators import evaluation as e


def test_at_k(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "a", 3), (2, "p", 1), (3, "z", 1)], "query_id int, id string, place int")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (2, "p"), (4, "q")], "query_id int, id string")
    found = {x.query_id: x for x in e.at_k(ranked, relevant, [2]).collect()}
    assert (found[1].hit, found[1].recall, found[1].rr) == (1.0, 0.5, 0.5)
    assert abs(found[1].ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12
    assert (found[2].ndcg, found[3].ndcg, found[4].ndcg, found[4].hit) == (1.0, None, 0.0, 0.0)
    row = e.metrics(e.at_k(ranked, relevant, [2])).first()
    assert (row.n_queries, row.hit_rate, row.recall, row.mrr) == (4, 0.5, 0.375, 0.375)


def test_sweep_searches_once(spark, folder):
    """The metrics read rankings and relevant documents several times, but the documents aren't searched again each time."""
    from corvine.operators import registry

    registry.load()
    for name in ("alpha_sweep", "retrieval_metrics_at_k"):
        plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "MapInArrow" not in plan, name


def test_average_precision(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "query_id int, place int, relevant boolean")
    assert {x.query_id: x.ap for x in e.average_precision(rows).collect()} == {1: round((1 + 2 / 3) / 3, 6), 2: 0.0}
    assert {x.query_id: x.ap for x in e.average_precision(rows, "relevant").collect()} == {1: round((1 + 2 / 3) / 2, 6), 2: 0.0}


def test_precision_recall(spark):
    rows = spark.createDataFrame([("s", "s")] * 3 + [("s", "u"), ("u", "s"), ("c", "u")], "e string, p string")
    found = {x["class"]: x for x in e.precision_recall(rows, "e", "p").collect()}
    assert (found["s"].precision, found["s"].recall, found["s"].f1, found["s"].support, found["s"].accuracy) == (0.75, 0.75, 0.75, 4, 0.5)
    assert (found["c"].precision, found["c"].recall, found["c"].f1) == (0, 0, 0)


def test_bootstrap(spark):
    source = random.Random(4)
    values = [source.random() for _ in range(200)]
    rows = spark.createDataFrame([("a", x) for x in values] + [("b", 1.0), ("b", 3.0), ("b", None)], "g string, x double")
    found = {x.g: x for x in e.bootstrap(rows, "g", "x", rounds=300).collect()}
    error = 1.96 * (sum((x - sum(values) / 200) ** 2 for x in values) / 200) ** 0.5 / 200**0.5
    assert found["a"].ci_lower < found["a"].mean < found["a"].ci_upper
    assert abs((found["a"].ci_upper - found["a"].ci_lower) - 2 * error) < 0.6 * error
    assert (found["b"].n, found["b"].mean, found["b"].ci_lower, found["b"].ci_upper) == (2, 2.0, 2.0, 2.0)


def test_bootstrap_of_many_equal_rows(spark):
    """Equal rows are drawn for together; the intervals are those of a resampling of single rows. Groups may be null, and be many."""
    import numpy as np

    values = [0.0] * 300 + [1.0] * 100
    rows = spark.createDataFrame([(None, x) for x in values] + [(f"g{i}", float(i % 7)) for i in range(2500) for _ in range(3)], "g string, x double").repartition(5)
    found = {x.g: x for x in e.bootstrap(rows, "g", "x", rounds=400).collect()}
    draws = np.random.default_rng(1).choice(values, (4000, 400)).mean(1)
    assert found[None].n == 400 and found[None].mean == 0.25
    assert abs(found[None].ci_lower - np.quantile(draws, 0.025)) < 0.012 and abs(found[None].ci_upper - np.quantile(draws, 0.975)) < 0.012
    assert len(found) == 2501 and all(found[f"g{i}"].mean == found[f"g{i}"].ci_lower == float(i % 7) for i in range(2500))
    again = {x.g: x for x in e.bootstrap(rows.repartition(2), "g", "x", rounds=400).collect()}
    assert again == found


def test_monitor(spark):
    rows = spark.createDataFrame([("m", i, 100.0 + i, i == 0) for i in range(30)] + [("n", 0, 5.0, True)], "g string, t int, ms double, low boolean")
    found = {x.g: x for x in e.last_window(rows, "g", [F.desc("t")], 25, ["ms"], ["low"], "ms").collect()}
    assert (found["m"]["count"], found["m"].avg_ms, found["m"].low_rate, found["m"].p95_ms) == (25, 117.0, 0.0, 128.0)
    assert (found["n"].p95_ms, found["n"].low_rate) == (5.0, 1.0)
    counts = {(x.g, x.le): x.n for x in e.histogram(rows, "g", "ms", e.LATENCY_BUCKETS).collect()}
    assert counts["m", "100.0"] == 1 and counts["m", "250.0"] == counts["m", "+Inf"] == 30


def test_best_setting(spark):
    rows = spark.createDataFrame([(0.3, 0.5), (0.7, 0.9), (0.5, 0.9)], "alpha double, recall double")
    assert tuple(e.best_setting(rows, "alpha", "recall").first()) == (0.5, 0.9)
