"""Pages from placed words, parsers in turn, checked traces, closed sessions, exposed counters."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvine.operators import evaluation, layout
from corvine.sources import files
from corvine.streaming import exposition, ingest, jobs

WORD = "page int, x0 double, x1 double, top double, bottom double, text string"
BOX = "page int, table int, x0 double, top double, x1 double, bottom double"


def word(page, x, y, text):
    return (page, float(x), float(x + 5 * len(text)), float(y), float(y + 10), text)


def test_tables_of_pages(spark):
    words = [
        # page 1: a table with a cell of two words, a merged cell below "fruit", one that is missing at the end, a bar; a title above, a line below in wrong order
        word(1, 10, 5, "Title"), word(1, 100, 200, "line"), word(1, 60, 200.5, "last"),
        word(1, 10, 50, "kind"), word(1, 100, 51, "full"), word(1, 125, 50, "name"), word(1, 200, 50, "n"),
        word(1, 10, 70, "fruit"), word(1, 101, 70, "ap|ple"), word(1, 200, 70, "1"),
        word(1, 99, 90, "pear"), word(1, 200, 90, "2"), word(1, 10, 90, " "),
        word(1, 10, 110, "nut"), word(1, 100, 110, "hazel"),
        # page 2: two tables side by side, no other text
        word(2, 10, 10, "a"), word(2, 10, 30, "b"), word(2, 310, 10, "c"), word(2, 360, 10, "d"),
        word(3, 10, 10, "only"), word(3, 50, 10, "text"), word(4, 5, 5, " "),
    ]
    boxes = [(1, 1, 0.0, 40.0, 300.0, 130.0), (2, 1, 0.0, 0.0, 200.0, 50.0), (2, 2, 300.0, 0.0, 500.0, 50.0), (9, 1, 0.0, 0.0, 9.0, 9.0)]
    random.Random(1).shuffle(words)
    got = {r.page: r.text for r in layout.page_texts(spark.createDataFrame(words, WORD), spark.createDataFrame(boxes, BOX)).collect()}
    assert got == {
        1: "| kind | full name | n |\n| --- | --- | --- |\n| fruit | ap\\|ple | 1 |\n| fruit | pear | 2 |\n| nut | hazel | 2 |\n\nTitle\nlast line",
        2: "| a |\n| --- |\n| b |\n\n| c | d |\n| --- | --- |", 3: "only text",
    }
    none = spark.createDataFrame([], BOX)
    assert {r.page: r.text for r in layout.page_texts(spark.createDataFrame(words, WORD), none).where("page = 3").collect()} == {3: "only text"}
    assert layout.page_texts(spark.createDataFrame([], WORD), none).count() == 0


def test_overlapping_boxes_take_a_word_once(spark):
    words = spark.createDataFrame([word(1, 10, 10, "x")], WORD)
    boxes = spark.createDataFrame([(1, 2, 0.0, 0.0, 99.0, 99.0), (1, 1, 0.0, 0.0, 99.0, 99.0)], BOX)
    assert [r.table for r in layout.inside(words, boxes).collect()] == [1]


def test_cascade_asks_the_next_parser_for_failures_only(spark, tmp_path):
    def stage(name, texts):
        def parse(path, content):
            (tmp_path / f"{name}-{path}").touch(exist_ok=False)  # a second attempt is an error
            if isinstance(texts.get(path), Exception):
                raise texts[path]
            return texts.get(path)

        return name, parse

    long = "a text that is long enough"
    given = spark.createDataFrame([(p, bytearray(b"x")) for p in "abcdefg"] + [("h", None)], "path string, content binary")
    stages = [stage("first", {"a": long, "b": OSError("broken"), "c": "short", "d": f"  {long}  "}), stage("second", {"b": long, "e": "brief"}), stage("third", {"c": "x" * 19, "f": ValueError("no"), "g": "hi"})]
    found, attempts = files.cascade(given, stages)
    got = {r.path: (r.text, r.stage, r.n_attempts, r.error) for r in found.collect()}
    assert got == {"a": (long, "first", 1, None), "b": (long, "second", 2, None), "c": ("x" * 19, "third", 3, None), "d": (long, "first", 1, None), "e": ("brief", None, 3, None), "f": (None, None, 3, "ValueError: no"), "g": ("hi", "third", 3, None), "h": (None, None, 3, "no text")}
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([f"first-{p}" for p in "abcdefgh"] + [f"second-{p}" for p in "bcefgh"] + [f"third-{p}" for p in "cefgh"])
    made = {(r.path, r.attempt): (r.stage, r.n_chars, r.error) for r in attempts.collect()}
    assert len(made) == 19 and made["b", 1] == ("first", 0, "OSError: broken") and made["c", 1] == ("first", 5, None)


def test_traces(spark):
    runs = {"good": ["planning", "tool_calling", "reflecting", "responding", "done"], "open": ["planning", "responding"], "skips": ["tool_calling", "reflecting", "done"], "null": ["planning", None, "responding"], "odd": ["planning", "dreaming", "done"], "twice": ["planning", "planning"], "failed": ["planning", "error", "done"], "on": ["planning", "responding", "done", "done"]}
    rows = [(k, i, s) for k, states in runs.items() for i, s in enumerate(states)]
    got = {r.t: tuple(r)[1:] for r in evaluation.checked_traces(spark.createDataFrame(rows, "t string, i int, s string"), "t", ["i"], "s").collect()}
    assert got == {
        "good": (5, 0, None, None, None, "done", True), "open": (2, 0, None, None, None, "responding", False), "skips": (3, 2, 1, "idle", "tool_calling", "done", False), "null": (3, 2, 2, "planning", None, "responding", False),
        "odd": (3, 2, 2, "planning", "dreaming", "done", False), "twice": (2, 1, 2, "planning", "planning", "planning", False), "failed": (3, 0, None, None, None, "done", True), "on": (4, 1, 4, "done", "done", "done", False),
    }


def test_sessions_and_late_rows(spark, tmp_path):
    start, r = datetime(2024, 1, 1), random.Random(4)
    rows = [(u, start + timedelta(minutes=r.randrange(3000)), float(r.randrange(9))) for u in range(5) for _ in range(60)]
    rows.sort(key=lambda x: x[1])
    late = [(1, start, 5.0), (2, start + timedelta(minutes=1), 5.0)]
    seen = ingest.Progress()
    spark.streams.addListener(seen)
    try:
        for part in (rows[:150], rows[150:], late):
            spark.createDataFrame(part, "u int, at timestamp, v double").write.mode("append").parquet(f"{tmp_path}/in")
            job = jobs.sessions(spark.readStream.schema("u int, at timestamp, v double").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", "at", "u", "v", "20 minutes", "10 minutes")
            job.awaitTermination()
            assert job.exception() is None
        import time

        for _ in range(50):
            if sum(q["late"] for q in seen.queries.values()) >= 2:
                break
            time.sleep(0.2)
        assert sum(q["late"] for q in seen.queries.values()) == 2
    finally:
        spark.streams.removeListener(seen)
    whole: dict = {}
    for u, at, v in rows:
        islands = whole.setdefault(u, [])
        if islands and at - islands[-1][-1][0] <= timedelta(minutes=20):
            islands[-1].append((at, v))
        else:
            islands.append([(at, v)])
    edge = rows[-1][1] - timedelta(minutes=10)
    want = {(u, i[0][0], i[-1][0] + timedelta(minutes=20), len(i), sum(v for _, v in i)) for u, islands in whole.items() for i in islands if i[-1][0] + timedelta(minutes=20) <= edge}
    assert {(x.u, x.session_start, x.session_end, x.n, x.total) for x in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_exposition(spark, tmp_path):
    metrics = [
        exposition.Counter("q_total", "Queries", "method", F.col("m")), exposition.Counter("low_total", "Low", when=F.col("v") < 1),
        exposition.Histogram("ms", "Time", {"b": F.col("v"), "a": F.col("w")}, (1.0, 10.0), "stage"), exposition.Histogram("share", "Share", {None: F.col("v")}, (0.5, 1.0), low=0.0, high=1.0),
    ]
    rows = [("x", 0.5, 2.0), (None, 3.0, None), ('q"t', 20.0, 30.0), ("x", None, 1.0)]
    schema = "m string, v double, w double"
    for n, part in enumerate((rows[:1], rows[1:3], rows[3:], rows[:0])):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(1 + (n == 1)):  # once more without anything new
            job = exposition.accumulate(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/counts", f"{tmp_path}/state", metrics)
            job.awaitTermination()
            assert job.exception() is None
    exposition.export(spark, f"{tmp_path}/counts", metrics, f"{tmp_path}/text")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/text", wholetext=True).collect())
    assert text.splitlines() == """# HELP q_total Queries
# TYPE q_total counter
q_total{method="none"} 1.0
q_total{method="q\\"t"} 1.0
q_total{method="x"} 2.0
# HELP low_total Low
# TYPE low_total counter
low_total 1.0
# HELP ms Time
# TYPE ms histogram
ms_bucket{le="1.0",stage="a"} 1.0
ms_bucket{le="10.0",stage="a"} 2.0
ms_bucket{le="+Inf",stage="a"} 3.0
ms_count{stage="a"} 3.0
ms_sum{stage="a"} 33.0
ms_bucket{le="1.0",stage="b"} 1.0
ms_bucket{le="10.0",stage="b"} 2.0
ms_bucket{le="+Inf",stage="b"} 3.0
ms_count{stage="b"} 3.0
ms_sum{stage="b"} 23.5
# HELP share Share
# TYPE share histogram
share_bucket{le="0.5"} 1.0
share_bucket{le="1.0"} 3.0
share_bucket{le="+Inf"} 3.0
share_count 3.0
share_sum 2.5""".splitlines()
