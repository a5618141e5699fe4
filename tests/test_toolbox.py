"""Tools that are called by name, and chunks from SQL."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corvine.functions import sql
from corvine.operators import chunks, toolbox

NOW = "2024-03-01 10:20:30"


@pytest.fixture(scope="module")
def box(spark):
    places = spark.createDataFrame([("Aachen", 1), ("Bonn", 2), ("bad Honnef", 3), (None, 4), ("", 5)], "name string, id int")
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue")], "id int, content string")

    def search(questions, most):
        met = docs.join(questions, F.contains(F.col("content"), F.col("text")))
        return met.select("query_id", F.length("content").cast("double").alias("score"), "content")

    return toolbox.Toolbox(toolbox.calculator(), toolbox.dates(F.lit(NOW).cast("timestamp")), toolbox.lookup({"places": (places, "name")}, 4), toolbox.knowledge_search(search))


CASES = [
    ("calculator", '{"expression": "1+2"}', [3.0], None), ("calculator", "{}", [], "missing: expression"), ("calculator", '{"expression": 5}', [], "expression must be of type string"), ("calculator", '{"expression": "x"}', [], "not an arithmetic expression"),
    ("nope", "{}", [], "unknown tool: nope"), (None, "{}", [], "unknown tool: "), ("calculator", "[1]", [], "arguments must be a JSON object"), ("calculator", '{"expression": "1", "z": 1, "b": null}', [], "unknown: b, z"), ("calculator", None, [], "arguments must be a JSON object"), ("calculator", "{bad", [], "arguments must be a JSON object"),
    ("calculator", '{"expression": null}', [], "missing: expression"), ("calculator", '{"expression": "a \\" b"}', [], "not an arithmetic expression"),
    ("datetime_info", '{"action":"diff","date1":"2024-02-28"}', [2], None), ("datetime_info", '{"action":"later"}', [], "action must be one of now, diff"), ("datetime_info", '{"action":"diff"}', [], "missing: date1"), ("datetime_info", '{"action":"diff","date1":"x"}', [], "not a date"), ("datetime_info", '{"action":"now"}', ["2024-03-01"], None),
    ("database_query", '{"table":"places","keyword":"ONN"}', ["Bonn", "bad Honnef"], None), ("database_query", '{"table":"places","keyword":"o"}', ["Bonn", "bad Honnef"], None), ("database_query", '{"table":"places","keyword":"zz"}', [None], None), ("database_query", '{"table":"places","limit":2.5}', [], "limit must be of type integer"), ("database_query", '{"table":"other"}', [], "table must be one of places"), ("database_query", '{"table":"places","keyword":"","limit":1}', [None], None),
    ("knowledge_search", '{"query":"red","top_k":1}', ["red red hen"], None), ("knowledge_search", '{"query":"red"}', ["red red hen", "red fox"], None), ("knowledge_search", '{"query":"green"}', [None], None),
]


def test_calls(spark, box):
    calls = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "call_id int, tool string, arguments string")
    got = {}
    for r in box.answered(calls).collect():
        assert r.error is None or r.result is None
        value = json.loads(r.result) if r.result else {}
        shown = next((value[k] for k in ("result", "diff_days", "date", "name", "content") if k in value), None)
        got.setdefault(r.call_id, []).append((shown, r.error))
    for i, (tool, arguments, results, error) in enumerate(CASES):
        expected = [(None, error)] if error else [(x, None) for x in results]
        assert sorted(got[i], key=str) == sorted(expected, key=str), (tool, arguments)
    assert box.answered(calls.limit(0)).count() == 0


def test_definitions_and_registration(box):
    shown = {d["function"]["name"]: d["function"] for d in box.definitions()}
    assert shown["datetime_info"]["parameters"]["properties"]["action"] == {"type": "string", "enum": ["now", "diff"]} and shown["datetime_info"]["parameters"]["required"] == ["action"]
    assert [d["function"]["name"] for d in box.definitions("calculator")] == ["calculator"]
    with pytest.raises(ValueError, match="already"):
        box.add(toolbox.calculator())
    run = lambda calls: calls
    for wrong in ({"arguments": {"a": "text"}}, {"arguments": {}, "required": ("a",)}, {"arguments": {}, "safety": "maybe"}):
        with pytest.raises(ValueError):
            toolbox.Tool("x", "", run=run, **wrong)


def test_offered(spark, box):
    said = spark.createDataFrame([(1, "今天 100%"), (2, None), (3, "哪个专业"), (4, "hello")], "i int, text string")
    assert {r.i: r.tools for r in box.offered(said).collect()} == {1: ["calculator", "datetime_info", "knowledge_search"], 2: ["knowledge_search"], 3: ["database_query", "knowledge_search"], 4: ["knowledge_search"]}


def test_chunks_from_sql(spark):
    sql.register(spark)
    texts = [(1, "One. " * 300), (2, None), (3, "  "), (4, "# A\nfirst\n# B\nsecond"), (5, "short")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    for call, options in (("chunk(text)", {}), ("chunk(text, 'fixed', 200, 50)", {"size": 200, "overlap": 50}), ("chunk(text, size => 300, strategy => 'sentence', overlap => 20)", {"strategy": "sentence", "size": 300, "overlap": 20}), ("chunk(text, 'markdown', 100)", {"strategy": "markdown", "size": 100}), ("chunk(text, 'semantic')", {"strategy": "semantic", "size": 800})):
        got = spark.sql(f"SELECT doc_id, c.* FROM {{docs}}, LATERAL {call} AS c", docs=docs)
        expected = chunks.chunk(docs, "doc_id", **options).select("doc_id", "chunk_index", "content", "total_chunks")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())), call
    for wrong in ("chunk(text, 'nope')", "chunk(text, 'fixed', -1)", "chunk(text, 'fixed', 10, 10)", "chunk(text, CAST(doc_id AS string))", "chunk(doc_id)", "chunk(text, strategy => 'markdown', overlap => 3)", "chunk(text, 'fixed', 'x')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {{docs}}, LATERAL {wrong}", docs=docs).count()


def test_calls_are_checked_once(spark):
    """Whatever the number of tools, a call's arguments are parsed once; each tool reads what the check has written."""
    calls = spark.createDataFrame([(1, "calculator", '{"expression": "1 + 1"}'), (2, "nothing", "{}")], "call_id long, tool string, arguments string")
    found = toolbox.Toolbox(toolbox.calculator(), toolbox.dates()).answered(calls)
    assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(x.call_id, x.error) for x in found.collect()} == {(1, None), (2, "unknown tool: nothing")}
