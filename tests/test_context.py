import random

import pytest
from pyspark.sql import functions as F

from corvine.operators import access, context, folds, graph
from corvine.operators import relational as r


def test_pack(spark):
    rows = [(1, 1, "s" * 60, "a" * 400), (1, 2, None, "  "), (1, 3, "t", "b" * 2000), (1, 4, "u", "c")]
    found = context.pack(spark.createDataFrame(rows, "query_id int, place int, source string, content string"), 500).orderBy("place").collect()
    assert [x.label for x in found] == ["[来源1]", "[来源2]"]
    assert found[0].block.startswith("[来源1]（" + "s" * 37 + "...）\n") and found[1].block.count("b") < 700
    assert sum(x.n_tokens + 5 for x in found) <= 506


def test_citations(spark):
    rows = spark.createDataFrame([(1, "x [来源3] y [来源1] z [来源3]"), (2, "none"), (3, "[来源1][来源2]"), (4, "[来源10] [来源2]"), (5, None)], "query_id int, answer string")
    found = {x.query_id: x.a for x in rows.select("query_id", context.renumbered(F.col("answer")).alias("a")).collect()}
    assert found == {1: "x [来源2] y [来源1] z [来源2]", 2: "none", 3: "[来源1][来源2]", 4: "[来源2] [来源1]", 5: None}
    sources = spark.createDataFrame([(1, n) for n in (1, 2, 3)], "query_id int, n int")
    assert {x.n: x.new_n for x in context.cite_order(sources, rows).collect()} == {1: 1, 3: 2, 2: 3}


def test_memory(spark):
    rows = [(1, t, "user", "x" * 20) for t in range(5)] + [(2, t, "user", "x" * 2000) for t in range(8)] + [(3, t, "user", "x" * 300) for t in range(10)] + [(4, t, "user", "x" * 9000) for t in range(3)]
    found: dict = {}
    for x in context.memory(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), budget=1000, recent=4).collect():
        found.setdefault(x.conv_id, {})[x.turn] = x.text
    assert sorted(found[1]) == [0, 1, 2, 3, 4] and sorted(found[2]) == [7] and sorted(found[3]) == [-1, 6, 7, 8, 9] and sorted(found[4]) == [1, 2]
    assert found[3][-1] == "[历史摘要] 之前进行了 6 轮对话。"


def test_corrective(spark):
    schema = "query_id int, content string, similarity double"
    first = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.1)], schema)
    second = spark.createDataFrame([(1, "b", 0.8), (2, "a", 0.7), (2, "b", 0.8), (3, "c", 0.2)], schema)
    found = sorted((x.query_id, x.place, x.content, x["round"]) for x in context.corrective(first, second).collect())
    assert found == [(1, 1, "a", 1), (2, 1, "a", 1), (2, 2, "b", 2), (3, 1, "c", 2)]


def test_grounding(spark):
    claims = spark.createDataFrame([(1, "the sky"), (1, "is green"), (2, "x")], "answer_id int, claim string")
    sources = spark.createDataFrame([(1, "The sky is blue"), (3, "unused")], "answer_id int, content string")
    found = {x.answer_id: tuple(x)[1:] for x in context.grounding(claims, sources).collect()}
    assert found == {1: (2, 1, 0, 0.5), 2: (1, 0, 0, 0.0), 3: (0, 0, 0, 1.0)}
    unknown = context.grounding(claims, sources, judge=lambda claim, contents: F.lit(None).cast("string"))
    assert {x.answer_id: (x.n_unknown, x.grounded_ratio) for x in unknown.collect()} == {1: (2, 1.0), 2: (1, 1.0), 3: (0, 1.0)}


def test_graph(spark):
    triples = [("k", "a", "r", "b", "c1", 1), ("k", "a", "r", "b", "c2", 2), ("k", "b", "r", "c", "c1", 1), ("k", "c", "r", "a", "c1", 1), ("k", "x", "r", "", "c", 1), ("l", "a", "r", "z", "c", 1), ("k", "d", "r", "e", "c", 1)]
    edges = graph.merged(spark.createDataFrame(triples, "kb_id string, src string, rel string, dst string, chunk_id string, document_id int"))
    assert edges.count() == 5 and edges.where("src = 'a' AND kb_id = 'k'").first().chunk_ids == ["c1", "c2"]
    asked = spark.createDataFrame([(1, "a", "k")], "query_id int, entity string, kb_id string")
    assert [(x.src, x.dst) for x in graph.around(edges, asked).orderBy("place").collect()] == [("a", "b"), ("b", "c"), ("c", "a")]
    assert [(x.src, x.dst) for x in graph.around(edges, asked, hops=1, limit=1).collect()] == [("a", "b")]
    assert graph.without_document(edges, spark.createDataFrame([(1,)], "document_id int")).count() == 0


def test_access(spark):
    resources = spark.createDataFrame([(1, 10, "s"), (2, 11, None), (3, 12, "t")], "resource_id int, owner_id int, organization_id string")
    users = spark.createDataFrame([(10, False), (11, False), (13, False), (99, True)], "user_id int, is_admin boolean")
    members = access.organizations_above(spark.createDataFrame([(13, "s/t"), (11, "u")], "user_id int, path string"))
    published = spark.createDataFrame([(11, 3), (10, 1)], "user_id int, resource_id int")
    found = {tuple(x) for x in access.visible(resources, users, members, published).collect()}
    assert found == {(10, 1, "owner"), (11, 2, "owner"), (11, 3, "published"), (13, 1, "organization"), (13, 3, "organization"), (99, None, "admin")}
    roles = spark.createDataFrame([(1, "r", 5, True), (1, "g", None, True), (2, "r", 5, False)], "user_id int, role string, organization_id int, active boolean")
    grants = spark.createDataFrame([("r", "write"), ("g", "read")], "role string, permission string")
    checks = spark.createDataFrame([(1, 5, "write"), (1, 6, "write"), (1, 6, "read"), (2, 5, "write")], "user_id int, organization_id int, permission string")
    assert {(x.user_id, x.organization_id, x.permission): x.allowed for x in access.allowed(access.permissions(roles, grants), checks).collect()} == {(1, 5, "write"): True, (1, 6, "write"): False, (1, 6, "read"): True, (2, 5, "write"): False}
    assert access.permissions(roles, grants, any_organization=True).where("organization_id IS NULL AND permission = 'write'").count() == 1


def test_folds(spark):
    rows = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 2.0, 59.0, 60.0, 61.0)] + [("b", 0.0)], "k string, t double")
    found = {(x.k, x.t): (x.admitted, x.retry_after) for x in folds.fold(rows, "k", ["t"], ["t"], "admitted boolean, remaining int, retry_after long", folds.sliding_log(2, 60.0)).collect()}
    assert [found["a", t] for t in (0.0, 1.0, 2.0, 59.0, 60.0, 61.0)] == [(True, 0), (True, 0), (False, 58), (False, 1), (True, 0), (True, 0)] and found["b", 0.0] == (True, 0)
    calls = spark.createDataFrame([("p", float(t), t < 5) for t in range(8)] + [("p", 40.0, False), ("p", 41.0, False)], "k string, t double, failed boolean")
    states = {x.t: (x.called, x.state) for x in folds.fold(calls, "k", ["t"], ["t", "failed"], "called boolean, state string", folds.circuit_breaker()).collect()}
    assert states[4.0] == (True, "open") and states[5.0] == (False, "open") and states[40.0] == (True, "closed") and states[41.0] == (True, "closed")
    bucket = {x.t: x.admitted for x in folds.fold(rows.where("k = 'a'"), "k", ["t"], ["t"], "admitted boolean, tokens double", folds.token_bucket(0.02, 2)).collect()}
    assert [bucket[t] for t in (0.0, 1.0, 2.0, 59.0)] == [True, True, False, True]


def test_relational(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "c", 6)], "id int, name string, org int")
    assert [x.id for x in r.where_all(rows, org=None).collect()] == [1] and r.where_all(rows, id=[1, 3], name="c").count() == 1
    assert r.search(rows, " ", ["name"], "id", 2).count() == 2 and r.search(rows, "B", ["name"], "id", 2).first().id == 2
    owned = spark.createDataFrame([(3,), (3,)], "k int")
    assert sorted(x.id for x in r.where_any_path(rows, "id", F.col("org") == 5, owned).collect()) == [2, 3]
    shown = r.page(rows, [F.asc("id")], 2, 2).collect()
    assert [(x.id, x.total, x.has_more) for x in shown] == [(3, 3, False)]
    codes = spark.createDataFrame([("X-24-998",), ("X-24-1000",), ("Y-1",)], "code string")
    assert r.next_code(codes, "code", "X-24").first()[0] == "X-24-1001" and r.next_code(codes, "code", "Z").first()[0] == "Z-001"


def test_concurrency(spark):
    rows = spark.createDataFrame([("a", 0.0, 10.0), ("a", 1.0, 100.0), ("a", 2.0, 1.0), ("a", 11.0, 5.0), ("a", 40.0, 1.0)], "k string, t double, d double")
    found = {x.t: (x.admitted, x.running) for x in folds.fold(rows, "k", ["t"], ["t", "d"], "admitted boolean, running int", folds.concurrency(2, 30.0)).collect()}
    assert found == {0.0: (True, 1), 1.0: (True, 2), 2.0: (False, 2), 11.0: (True, 2), 40.0: (True, 1)}


def test_folds_of_rows_without_a_key(spark):
    """A null key is one key, whatever its type; large keys stay as they are beside nulls, and NaN is a key of its own."""
    steps = {"sliding": ("admitted boolean, remaining int, retry_after long", ["t"], folds.sliding_log(2, 100.0)), "bucket": ("admitted boolean, tokens double", ["t"], folds.token_bucket(0.001, 2)), "running": ("admitted boolean, running int", ["t", "d"], folds.concurrency(2, 900.0)), "breaker": ("admitted boolean, state string", ["t", "failed"], folds.circuit_breaker(2, 10, 900.0))}
    big = 2**62 + 1
    for kind, keys in (("long", [None, big, big + 1]), ("string", [None, "a", ""]), ("double", [None, float("nan"), 1.0]), ("timestamp", [None, __import__("datetime").datetime(2024, 1, 1)])):
        rows = spark.createDataFrame([(k, float(t), 800.0, True, "x") for k in keys for t in range(6)], f"k {kind}, t double, d double, failed boolean, null_key string")
        for name, (columns, needs, step) in steps.items():
            got = folds.fold(rows, "k", ["t"], needs, columns, step).collect()
            admitted = {}
            for r in got:
                admitted.setdefault(str(r.k), []).append(r.admitted)
            assert {k: sum(v) for k, v in admitted.items()} == {str(k): 2 for k in keys}, (kind, name)


def test_visible_shuffles_no_pairs(spark):
    """Users and resources of an organization meet in blocks, whatever their number; repeated resources and several common organizations give a pair once."""
    users = spark.range(40).select(F.col("id").alias("user_id"), (F.col("id") == 39).alias("is_admin"))
    members = users.select("user_id", F.explode(F.array(F.lit("a"), F.when(F.col("user_id") % 2 == 0, "b").otherwise("c"))).alias("organization_id"))
    resources = spark.range(60).select((F.col("id") % 50).alias("resource_id"), (F.col("id") % 7).alias("owner_id"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").when(F.col("id") % 4 == 2, "d").alias("organization_id"))
    published = spark.range(0, 40).select(F.col("id").alias("user_id"), (F.col("id") + 10).alias("resource_id"))
    owners, organizations, own = {}, {}, {}
    for row in resources.collect():
        owners.setdefault(row.resource_id, set()).add(row.owner_id)
        organizations.setdefault(row.resource_id, set()).add(row.organization_id)
    for row in members.collect():
        own.setdefault(row.user_id, set()).add(row.organization_id)
    wanted = {(39, None, "admin")}
    for u in range(39):
        for x in range(50):
            ways = [u in owners[x], bool(own[u] & (organizations[x] - {None})), x == u + 10]
            if any(ways):
                wanted.add((u, x, ("owner", "organization", "published")[ways.index(True)]))
    for block in (3, 1000):
        found = access.visible(resources, users, members, published, block=block)
        got = [tuple(x) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(way" not in plan


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pairs_of_one_organization_are_only_listed(spark, block):
    """Of resources with one organization no pair with a user is looked at: ids go out as they are, or without what the user owns."""
    r = random.Random(11)
    users = [(u, u % 5 == 0) for u in range(1, 16)]
    members = [(u, f"o{o}") for u, _ in users for o in range(4) if r.random() < 0.4]
    owned = [(x, r.randrange(1, 19)) for x in range(40) for _ in range(1 + x % 3)]  # up to three owners, one organization
    resources = [(x, o, f"o{x % 4}") for x, o in owned] + [(100 + x, 3, f"o{o}") for x in range(6) for o in (x % 4, (x + 1) % 4)] + [(200, None, None), (None, 4, "o1")]
    frames = spark.createDataFrame(resources, "resource_id long, owner_id long, organization_id string"), spark.createDataFrame(users, "user_id long, is_admin boolean"), spark.createDataFrame(members, "user_id long, organization_id string")
    found = access.visible(*frames, block=block)
    plain, admins = [u for u, a in users if not a], [u for u, a in users if a]
    want = {(u, None, "admin") for u in admins}
    for x in {x for x, _, _ in resources}:
        owners, organizations = {o for i, o, _ in resources if i == x}, {g for i, _, g in resources if i == x}
        want |= {(u, x, "owner" if u in owners else "organization") for u in plain if u in owners or organizations & {g for m, g in members if m == u}}
    rows = [tuple(x) for x in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("Generate explode(seen" in line for line in plan) and sum("array_intersect" in line for line in plan) == 1
