"""Hierarchies of any depth, with cycles, against walks on the driver."""

import random

import pytest

from corvine.operators import relational, trees


def frame(spark, edges):
    return spark.createDataFrame(edges, "id long, up long")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def chain(n):
    return [(i, i - 1 if i else None) for i in range(n)]


def walk_down(edges, start):
    found, level = set(start), set(start)
    while level:
        level = {k for k, p in edges if p in level} - found
        found |= level
    return found


def walk_up(edges, start):
    up = {}
    for k, p in edges:
        if p is not None:
            up.setdefault(k, set()).add(p)
    out = set()
    for node in start:
        seen, level, distance = {node: 0}, {node}, 0
        while level:
            distance += 1
            level = {p for k in level for p in up.get(k, ())} - set(seen)
            seen |= dict.fromkeys(level, distance)
        out |= {(node, a, d) for a, d in seen.items()}
    return out


def test_chain_of_a_thousand(spark):
    rows = frame(spark, chain(1000))
    assert {r.id for r in trees.descendants(rows, ids(spark, 0), "id", "up").collect()} == set(range(1000))
    assert {r.id for r in trees.descendants(rows, ids(spark, 970), "id", "up").collect()} == set(range(970, 1000))
    got = trees.ancestors(rows, ids(spark, 999, 5), "id", "up").collect()
    assert {tuple(r) for r in got} == walk_up(chain(1000), [999, 5]) and len(got) == 1006
    assert {tuple(r) for r in trees.depths(rows, "id", "up").collect()} == {(i, 0, i + 1) for i in range(1000)}
    assert trees.cyclic(rows, "id", "up").count() == 0


CASES = {
    "ring": [(i, (i + 1) % 7) for i in range(7)],
    "tail into a ring": [(i, (i + 1) % 5) for i in range(5)] + [(10 + i, 9 + i if i else 3) for i in range(20)] + chain(3)[1:],
    "itself": [(1, 1), (2, 1), (3, None), (4, 3)],
    "missing parent": [(1, 99), (2, 1), (3, None)],
    "two parents": [(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (5, 4)],
    "nulls": [(None, 1), (1, None), (2, 1), (None, None)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_odd_shapes(spark, name):
    edges = CASES[name]
    rows = frame(spark, edges)
    known = sorted({k for k, _ in edges if k is not None})
    real = [(k, p) for k, p in edges if k is not None]
    for start in (known[:1], known[-2:], [99], [None, 12345]):
        got = [r.id for r in trees.descendants(rows, ids(spark, *start), "id", "up").collect()]
        assert set(got) == walk_down(real, [s for s in start if s is not None]) and len(got) == len(set(got))
    got = [tuple(r) for r in trees.ancestors(rows, ids(spark, *known, *known), "id", "up").collect()]
    assert set(got) == walk_up(real, known) and len(got) == len(set(got))
    loops = {k for k in known if goes_round(real, k)}
    assert {r.id for r in trees.cyclic(rows, "id", "up").collect()} == loops


def goes_round(edges, node):
    """Some way up from a node comes to a node twice."""
    above = {a for _, a, _ in walk_up(edges, [node])}
    return any(p in above and k in {a for _, a, _ in walk_up(edges, [p])} for k, p in edges if k in above and p is not None)


def test_depths_of_odd_nodes(spark):
    rows = frame(spark, [*CASES["ring"], (20, 99), (21, 20), (30, None), (31, 30), (32, 31), (40, 2)])
    got = {r.node: (r.root, r.depth) for r in trees.depths(rows, "id", "up").collect()}
    assert {k: v for k, v in got.items() if v[0] is not None} == {30: (30, 1), 31: (30, 2), 32: (30, 3)}
    assert set(got) == {*range(7), 20, 21, 30, 31, 32, 40}


def test_random_forest(spark):
    r = random.Random(6)
    edges = [(i, r.randrange(max(0, i - 4), i) if i % 37 else None) for i in range(400)]
    rows = frame(spark, edges)
    assert {tuple(x) for x in trees.ancestors(rows, ids(spark, *range(0, 400, 3)), "id", "up").collect()} == walk_up(edges, range(0, 400, 3))
    assert {x.id for x in trees.descendants(rows, ids(spark, 3, 60, 222), "id", "up").collect()} == walk_down(edges, [3, 60, 222])


def test_deletes_and_archives_below_level_sixteen(spark):
    from pyspark.sql import functions as F

    rows = frame(spark, chain(40)).selectExpr("id", "up", "'success' AS status", "CAST(NULL AS date) AS archived_at", "CAST(NULL AS string) AS error")
    left = relational.without_subtree(rows, ids(spark, 10), "id", "up", {"notes": rows.select("id", "status")})
    assert {n: {x.id for x in t.collect()} for n, t in left.items()} == {"rows": set(range(10)), "notes": set(range(10))}
    gone = relational.archived(rows, ids(spark, 10), "id", "up", F.lit("2024-05-01").cast("date"))
    assert {x.id for x in gone.where("status = 'archived'").collect()} == set(range(10, 40))
    back = relational.restored(gone, ids(spark, 20), "id", "up", F.lit(True), F.lit(True))
    assert {x.id for x in back.where("status = 'success'").collect()} == {*range(10), *range(20, 40)}
