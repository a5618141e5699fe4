"""Questions before a search: fallbacks of models, rules first."""

from pyspark.sql import functions as F

from corvine.functions import constraints
from corvine.operators import evaluation, relational, rewriting


def test_condensed(spark):
    told = [("user", "q one"), ("assistant", "a" * 500), ("user", "q two"), ("assistant", None), (None, "x")]
    rows = [(1, "and then?", told), (2, "first", []), (3, "no history", None), (4, "fails", told), (5, "blank", told), (6, None, told), (7, "long", [("user", f"m{i}") for i in range(20)])]
    asked = spark.createDataFrame(rows, "query_id int, text string, history array<struct<role:string,content:string>>")
    seen = {}

    def model(question, history):
        if question == "fails":
            raise ValueError("no")
        if question == "blank":
            return ' "" '
        return f" “{question} | {len(history)} | {max(len(c) for _, c in history)} | {history[-1]}” "

    got = {r.query_id: r.condensed for r in rewriting.condensed(asked, model).collect()}
    assert got == {1: "and then? | 5 | 300 | ('', 'x')", 2: "first", 3: "no history", 4: "fails", 5: "blank", 6: None, 7: "long | 6 | 3 | ('user', 'm19')"}
    assert rewriting.condensed(asked).where("query_id = 1").first().condensed == "q two and then?" and not seen


def test_hypothetical(spark):
    asked = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "blank")], "query_id int, text string")

    def model(question):
        if question == "bad":
            raise ValueError("no")
        return " " if question == "blank" else f" answer to {question} "

    assert {r.query_id: r.search_text for r in rewriting.hypothetical(asked, model).collect()} == {1: "answer to a", 2: None, 3: "bad", 4: "blank"}


def test_understood(spark, tmp_path):
    asked = spark.createDataFrame([(1, "2019年的通知"), (2, "计科的课"), (3, "x"), (4, "bad"), (5, None), (6, "1800年"), (7, "near")], "query_id int, text string")

    def model(question):
        (tmp_path / question).touch()
        if question == "bad":
            raise ValueError("no")
        return {"x": 'so: {"year": "2020", "department": "计科", "semantic_query": "y"} !', "near": '{"department": "软件与计算机系", "category": " "}'}.get(question, "{broken")

    got = {r.query_id: (r.year, r.department, r.category, r.semantic_query, r.source) for r in rewriting.understood(asked, model).collect()}
    full = "计算机科学与工程学院"
    assert got == {1: ("2019", None, None, "2019年的通知", "rule"), 2: (None, full, None, "计科的课", "rule"), 3: ("2020", full, None, "y", "model"), 4: (None, None, None, "bad", "none"), 5: (None, None, None, None, "none"), 6: (None, None, None, "1800年", "none"), 7: (None, full, None, "near", "model")}
    assert {p.name for p in tmp_path.iterdir()} == {"x", "bad", "1800年", "near"}  # only where rules find nothing
    assert {r.source for r in rewriting.understood(asked).collect()} == {"rule", "none"}


def test_sites_limits_and_averages(spark):
    urls = {"https://jwc.a.edu/x": "教务处", "http://new.a.edu": "new", "http://jwc.b.edu": "", "http://a.edu": "", "ftp://jwc.a.edu": "", "http://jwc.aXedu": "", "": "", None: None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").withColumn("d", constraints.department_of_site(F.col("u"), "a.edu"))
    assert {r.u: r.d for r in rows.collect()} == urls
    numbers = spark.range(30)
    got = lambda **o: [(r.id, r.at_limit) for r in relational.limited(numbers, [F.asc("id")], **o).collect()]
    assert got(limit=3, offset=2) == [(2, False), (3, False), (4, False)] and len(got(limit=99, most=10)) == 10 and all(a for _, a in got(limit=99, most=10)) and got(limit=0) == got(offset=99) == got(limit=-1) == []
    scored = spark.createDataFrame([(1.0, 0.5, False), (0.5, None, False), (9.0, 9.0, True), (9.0, 9.0, None)], "a double, b double, f boolean")
    assert tuple(evaluation.batch_averages(scored, ["a", "b"], F.col("f")).first()) == (4, 2, 2, 0.75, 0.5)
    assert tuple(evaluation.batch_averages(scored.where("f"), ["a"], F.col("f")).first()) == (1, 0, 1, None)
    assert tuple(evaluation.batch_averages(scored.limit(0), ["a"], F.col("f")).first()) == (0, 0, 0, None)
