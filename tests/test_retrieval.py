import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvine.functions import text as text_functions
from corvine.functions import vectors as v
from corvine.operators import retrieval as r


def results(spark, rows, columns="query_id int, chunk_id string, score double"):
    return spark.createDataFrame(rows, columns)


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "cat dog cat"), (2, "dog bird"), (3, "fish"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat bird"), (2, "nothing"), (3, None)], "query_id long, text string")
    found = {(x.query_id, x.doc_id): x.score for x in r.bm25(docs, queries, "doc_id", 10).collect()}
    average = 6 / 4

    def part(tf, length, df):
        c = tf / (0.25 + 0.75 * length / average)
        return math.log(5 / (df + 0.5)) * 2.5 * (c + 0.5) / (1.5 + c + 0.5)

    assert found == {(1, 1): round(part(2, 3, 1), 6), (1, 2): round(part(1, 2, 1), 6)}


def test_fusion_prefers_double_hits_and_bounds(spark):
    vector = results(spark, [(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7)])
    lexical = results(spark, [(1, "b", 9.0), (1, "d", 8.0)])
    found = r.fuse(lexical, vector, "chunk_id", 3).orderBy(F.desc("score")).collect()
    assert len(found) == 3 and len({x.chunk_id for x in found}) == 3
    by_id = {x.chunk_id: x for x in found}
    assert round(0.7 / 61 + 0.3 / 60, 9) == by_id["b"].score and found[0].chunk_id == "b"
    assert by_id["b"].similarity == round(0.7 * 0.8 + 0.3 / (1 + math.exp(-0.9)), 9)
    weak = r.fuse(results(spark, []), results(spark, [(2, "x", 0.1), (2, "y", 0.2)]), "chunk_id", 3).collect()
    assert [x.chunk_id for x in weak] == ["y"]
    assert r.fuse(results(spark, []), results(spark, []), "chunk_id", 3).count() == 0


def test_passing_or_first(spark):
    rows = results(spark, [(1, c, s) for c, s in zip("abcd", (0.9, 0.8, 0.2, 0.1), strict=True)] + [(2, "a", 0.1)])
    kept = r.passing_or_first(rows, F.col("score") > 0.5, 10, F.desc("score"), F.asc("chunk_id"), least=3)
    assert sorted((x.query_id, x.chunk_id) for x in kept.collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]


def test_relax(spark):
    tier = lambda *rows: results(spark, [(q, c, 1.0) for q, c in rows])
    found = r.relax([tier((1, "a"), (1, "b"), (2, "a")), tier((1, "a"), (2, "a"), (2, "b"), (3, "c")), tier((1, "z"), (2, "z"), (3, "z"), (4, "z"))]).collect()
    assert {(x.query_id, x.tier) for x in found} == {(1, 1), (2, 2), (3, 2), (4, 3)}


def test_mmr(spark):
    rows = [(1, "a", 0.9, "the same words"), (1, "b", 0.89, "the same words"), (1, "c", 0.5, "something else"), (2, "x", 0.1, "")]
    pool = results(spark, [x[:3] for x in rows])
    contents = spark.createDataFrame([x[1::2] for x in rows], "chunk_id string, content string")
    places = lambda **options: sorted((x.query_id, x.place, x.chunk_id) for x in r.mmr(pool, contents, "chunk_id", 2, **options).collect())
    assert places() == [(1, 1, "a"), (1, 2, "c"), (2, 1, "x")]
    assert places(weight=0.95) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "x")]
    assert places(weight=0.6, scaled=True) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "x")]  # of scores 1, 0.975, 0


def plain_mmr(pool, texts, n, weight):
    """Greedy choice over sets of trigrams, in plain Python."""
    grams = {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, t in texts.items()}
    left = sorted(pool, key=lambda x: (-x[1], x[0]))
    chosen = [left.pop(0)]
    while left and len(chosen) < n:
        worth = lambda x: weight * x[1] - (1 - weight) * max(len(grams[x[0]] & grams[c[0]]) / len(grams[x[0]] | grams[c[0]]) for c in chosen)  # noqa: B023, E731
        pick = max(left, key=lambda x: (round(worth(x), 12), x[1], -x[0]))
        left.remove(pick)
        chosen.append(pick)
    return [c[0] for c in chosen]


def test_mmr_against_plain_version(spark, folder):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect() if len(x.text) > 2}
    g = np.random.default_rng(4)
    pools = {q: [(int(k), float(s)) for k, s in zip(g.choice(list(texts), 15, replace=False), g.random(15).round(3), strict=True)] for q in range(5)}
    found: dict = {}
    contents = spark.createDataFrame(list(texts.items()), "doc_id long, content string")
    for x in r.mmr(spark.createDataFrame([(q, k, s) for q, p in pools.items() for k, s in p], "query_id int, doc_id long, score double"), contents, "doc_id", 8).orderBy("place").collect():
        found.setdefault(x.query_id, []).append(x.doc_id)
    assert found == {q: plain_mmr(p, texts, 8, 0.7) for q, p in pools.items()}


def test_boolean_and_synonyms(spark):
    docs = spark.createDataFrame([(1, "the red automobile stops"), (2, "a car, red"), (3, "red red"), (4, "green"), (5, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red car"), (2, "zebra")], "query_id long, text string")
    plain = {x.doc_id: x.score for x in r.boolean_phrase(docs, asked, "doc_id", 10).collect()}
    assert plain == {1: 0.5, 2: 4.0, 3: 0.5}
    same = {x.doc_id: x.score for x in r.boolean_phrase(docs, asked, "doc_id", 10, tokens=text_functions.with_synonyms([["car", "automobile"]])).collect()}
    assert same == {1: 9.0, 2: 4.0, 3: 0.5}


def test_blocks_of_queries_and_ties(spark):
    docs = spark.createDataFrame([(f"d{i}", "same words here" if i % 2 else f"other {i % 7}") for i in range(60)], "doc_id string, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", f"words {i % 7}") for i in range(9)], "query_id string, text string")
    got = sorted(tuple(x) for x in r.bm25(docs, asked, "doc_id", 4, block=2).collect())
    assert got == sorted(tuple(x) for x in r.bm25(docs, asked, "doc_id", 4).collect()) and len(got) == 36
    ties = sorted(f"d{i}" for i in range(1, 60, 2))
    for q in range(9):
        mine = [(s, d) for a, d, s in got if a == f"q{q}"]
        low = min(s for s, _ in mine)
        own = sorted(d for s, d in mine if s == low and d in ties)
        assert own == ties[: len(own)]


def test_merge_stats(spark):
    rows = spark.createDataFrame([(1, 0, 5, "a", "x", 0.4, None), (1, 1, 6, "b", "y", 0.8, None), (1, 1, 7, "c", "z", 0.1, None), (2, 0, 5, "a", "x", 0.5, None)], "query_id int, layer int, kb_id int, chunk_id string, content string, similarity double, final_score double")
    found = {x.query_id: x for x in r.merge_stats(r.merge_layers(rows, n=2), rows).collect()}
    assert (found[1].kb_ids, found[1].kb_id, found[1].avg_similarity, found[1].total_results, found[1].total_found, found[1].has_result_kb_ids, found[1].fallback_used) == ([6, 5], 6, 0.6, 2, 3, [5, 6, 7], True)
    assert not found[2].fallback_used


def test_cosine_topk(spark):
    random = np.random.default_rng(1)
    points = random.standard_normal((200, 8))
    points[7] = 0
    rows = spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(points)], "vec_id long, embedding array<double>, kb_id int")
    queries = rows.where("vec_id < 9 AND vec_id <> 7").withColumnRenamed("vec_id", "query_id")
    units = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    for within, block in ((None, 10000), (None, 2), (["kb_id"], 3)):
        found: dict = {}
        for x in r.cosine_topk(rows, queries, "vec_id", 5, within=within, block=block).collect():
            found.setdefault(x.query_id, set()).add(x.vec_id)
        for q in found:
            order = [i for i in np.argsort(-np.round(units @ units[q], 6), kind="stable") if not within or i % 3 == q % 3]
            assert found[q] == set(order[:5])
        assert len(found) == 8


def test_cosine_topk_odd_vectors(spark):
    """Null vectors and those of another length have no score and come last, holes count as zero vectors; queries and vectors aren't multiplied as rows."""
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [-1.0, 0.0]), (7, [2.0, 0.0])], "vec_id long, embedding array<float>")
    found = r.cosine_topk(rows, rows.where("vec_id < 1").withColumnRenamed("vec_id", "query_id"), "vec_id", 10)
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "CartesianProduct" not in plan
    got = {x.vec_id: x.score for x in found.collect()}
    assert got == {0: 1.0, 1: 0.6, 2: None, 3: None, 4: 0.0, 5: 0.0, 6: -1.0, 7: 1.0}
    first = r.cosine_topk(rows, rows.where("vec_id < 1").withColumnRenamed("vec_id", "query_id"), "vec_id", 1).collect()
    assert [(x.vec_id, x.score) for x in first] == [(0, 1.0)]
    assert r.cosine_topk(rows, rows.where("vec_id < 0").withColumnRenamed("vec_id", "query_id"), "vec_id", 1).count() == 0


def test_merge_and_rewrites(spark):
    rows = spark.createDataFrame([(1, 0, 5, "a", "x", 0.4, None), (1, 1, 5, "a", "x", 0.9, None), (1, 1, 6, "a", "x", 0.3, 0.8)], "query_id int, layer int, kb_id int, chunk_id string, content string, similarity double, final_score double")
    assert [(x.kb_id, x.place, x.total_found) for x in r.merge_layers(rows).orderBy("place").collect()] == [(6, 1, 2), (5, 2, 2)]
    found = r.union_of_rewrites(spark.createDataFrame([(1, "a", 0.1, 0), (1, "a", 0.9, 1), (1, "b", 0.5, 1)], "query_id int, chunk_id string, score double, rewrite int"), "chunk_id", 5)
    assert sorted((x.chunk_id, x.score) for x in found.collect()) == [("a", 0.1), ("b", 0.5)]


def test_distance(spark):
    row = spark.range(1).select(v.similarity_of_distance(F.lit(1.5)), v.similarity_of_distance(F.lit(0.25)), v.similarity_of_distance(F.lit(3.0), "l2"), v.squash(F.lit(0.0)), v.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert tuple(row) == (0.0, 0.75, 0.25, 0.5, 0.0)


def test_batches_are_looked_at_in_parts():
    """However many rows a batch has, a bounded number is looked at at a time; none is lost."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1234)), pa.array([["a"] * (n % 3) for n in range(1234)])], names=["doc_id", "__w"])
    parts = list(r._some_at_a_time(iter([batch])))
    assert max(p.num_rows for p in parts) <= r.ROWS_AT_A_TIME and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
