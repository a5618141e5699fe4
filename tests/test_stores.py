"""Both back ends of the store interface; pruning, commits and conflicts of the data source."""

import pytest
from pyspark.sql import functions as F

from corvine.sources import stores

ROWS = [(f"{kb}-{i}", f"text {i}", [float(i), 1.0], f"d{i % 3}", "s", None, "D", {"k": "v"}, kb) for kb in (1, 2, 3) for i in range(9)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, stores.SCHEMA)


def shown(store, *kb_ids):
    return sorted((r.kb_id, r.chunk_id, r.content, tuple(r.embedding or ()), r.metadata and r.metadata["k"]) for r in store.read(*kb_ids).collect())


@pytest.mark.parametrize("kind", ["folders", "committed"])
def test_same_answers(spark, tmp_path, kind):
    store = stores.store(spark, str(tmp_path / "s"), kind)
    assert isinstance(store, stores.Store)
    store.append(frame(spark).repartition(3))
    store.append(spark.createDataFrame([("9-0", "less", 9)], "chunk_id string, content string, kb_id long"))
    store.upsert(frame(spark, [("1-0", "changed", None, "d0", None, None, None, None, 1), ("1-99", "new", None, "d9", None, None, None, None, 1)]))
    store.delete(2, spark.createDataFrame([("d0",), ("d0",)], "document_id string"), ["document_id"])
    store.delete(9, spark.createDataFrame([("9-0",)], "chunk_id string"), ["chunk_id"])  # its last one
    store.drop(3)
    store.drop(77)
    expected = {(1, f"1-{i}"): f"text {i}" for i in range(1, 9)} | {(1, "1-0"): "changed", (1, "1-99"): "new"} | {(2, f"2-{i}"): f"text {i}" for i in range(9) if i % 3}
    assert {(k, c): t for k, c, t, *_ in shown(store)} == expected
    assert {k for k, *_ in shown(store, 2)} == {2} and shown(store, 3, 9) == []
    assert next(r for r in shown(store, 2) if r[1] == "2-1")[3:] == ((1.0, 1.0), "v")


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        stores.store(spark, "x", "other")


def test_pruning_is_in_the_plan(spark, tmp_path):
    store = stores.store(spark, str(tmp_path / "s"), "committed")
    store.append(frame(spark).repartition(1))
    assert store.read().rdd.getNumPartitions() == 3
    one = store.read(2)
    assert one.rdd.getNumPartitions() == 1 and one.count() == 9
    assert store.read().where("kb_id = 2 AND content = 'text 3'").count() == 1
    assert store.read().where("kb_id = 2 AND kb_id = 3").count() == 0 and store.read(55).count() == 0


def test_commits(spark, tmp_path):
    store = stores.store(spark, str(tmp_path / "s"), "committed")
    assert store.read().count() == 0 and store.commits() == 0
    store.append(frame(spark))
    before = sorted(p.name for p in (tmp_path / "s" / "files").iterdir())
    with pytest.raises(Exception, match="broken"):  # a task fails: nothing of the write is seen, or left
        store.append(frame(spark).repartition(2).withColumn("content", F.when(F.col("chunk_id") == "3-8", F.raise_error(F.lit("broken"))).otherwise(F.col("content"))))
    assert store.commits() == 1 and store.read().count() == 27
    assert set(before) <= {p.name for p in (tmp_path / "s" / "files").iterdir()}
    # a write that began before another one's commit isn't made
    late = stores._Writer(str(tmp_path / "s"), False, set())
    message = late.write(iter(frame(spark).limit(2).toArrow().to_batches()))
    store.append(frame(spark, ROWS[:1]))
    with pytest.raises(RuntimeError, match="in between"):
        late.commit([message])
    assert store.commits() == 2 and store.read().count() == 28
    # a reader keeps what it began with
    plan = store.read(1)
    assert plan.count() == 10
    store.drop(1)
    assert store.read(1).count() == 0 and store.commits() == 3
    assert store.vacuum() > 0 and store.commits() == 3 and store.read().count() == 18
