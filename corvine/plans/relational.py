"""Queries of the relational operators. Organizations are region / nation / customer, members are orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvine.operators import relational as r
from corvine.operators import trees
from corvine.operators.registry import query


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filter_eq_and(t):
    return r.where_all(t("orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000
    OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)""")
def filter_or_access_paths(t):
    owners = t("customer").where("c_nationkey = 3").select("c_custkey")
    listed = t("lineitem").where("l_quantity = 50 AND l_discount = 0.1").select("l_orderkey")
    admitted = r.where_any_path(t("orders"), "o_custkey", F.col("o_totalprice") > 400000, owners).select("o_orderkey", "o_custkey")
    shared = t("orders").join(listed.distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")
    return admitted.union(shared).distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%er#00%1%' OR c_mktsegment ILIKE '%mach%' ORDER BY c_custkey LIMIT 20")
def ilike_search_topn(t):
    return r.search(t("customer").where("c_name ILIKE '%er#00%1%' OR c_mktsegment ILIKE '%mach%'"), "", [], "c_custkey", 20).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%BUILD%' OR c_mktsegment ILIKE '%BUILD%' ORDER BY c_custkey LIMIT 20")
def ilike_keyword_topn(t):
    return r.search(t("customer"), "BUILD", ["c_name", "c_mktsegment"], "c_custkey", 20).select("c_custkey", "c_name")


def organizations(t):
    """node (text), parent, name, path of regions, nations and customers."""
    regions = r.with_path(t("region"), "r_regionkey", "")
    nations = r.with_path(t("nation"), "n_nationkey", "n_regionkey", regions, parent_key="r_regionkey")
    customers = r.with_path(t("customer"), "c_custkey", "c_nationkey", nations, parent_key="n_nationkey")
    return (
        regions.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), "path")
        .union(nations.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", "path"))
        .union(customers.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name", "path"))
    )


ORGANIZATIONS = """org AS (
  SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name, r_regionkey::VARCHAR AS path FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_regionkey || '/' || n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, n_regionkey || '/' || n_nationkey || '/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"WITH {ORGANIZATIONS} SELECT node, name, path FROM org WHERE path = '1' OR path LIKE '1/%'")
def prefix_subtree(t):
    return r.subtree(organizations(t), "1").select("node", "name", "path")


@query("""SELECT a.event_type, a.k, a.n, b.n AS m FROM
    (SELECT event_type, nullif(event_id % 7, 3) AS k, count(*) AS n FROM events GROUP BY ALL) a JOIN
    (SELECT event_type, nullif(event_id % 5, 3) AS k, count(*) AS n FROM events GROUP BY ALL) b ON a.event_type = b.event_type AND a.k IS NOT DISTINCT FROM b.k""")
def null_safe_match(t):
    def side(n, key, count):
        return t("events").groupBy(F.col("event_type").alias(f"type_{key}"), F.expr(f"nullif(event_id % {n}, 3)").alias(key)).agg(F.count("*").alias(count))

    met = side(7, "k", "n").join(side(5, "j", "m"), (F.col("type_k") == F.col("type_j")) & F.col("k").eqNullSafe(F.col("j")))
    return met.select(F.col("type_k").alias("event_type"), "k", "n", "m")


@query("""SELECT s_suppkey, s_name, p_brand, count(*) AS n_lines FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
    WHERE p_size = 15 GROUP BY ALL""")
def inner_bridge_join(t):
    parts = t("part").where("p_size = 15").select("p_partkey", "p_brand")
    bridge = t("lineitem").select("l_partkey", "l_suppkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    # counted on the bridge's keys first: fewer rows meet the supplier's names
    counted = bridge.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n_lines"))
    return counted.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "p_brand", "n_lines")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN
    (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)))""")
def semi_join_chain(t):
    customers = t("customer").where("c_nationkey = 5").select("c_custkey")
    orders = t("orders").where("o_orderpriority = '1-URGENT'").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_suppkey").distinct()
    return t("supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_orphans(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""WITH binding AS (SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 1993 + n_nationkey % 5 END AS yr FROM nation)
    SELECT nation, yr, count(DISTINCT o_orderkey) AS n_orders FROM binding JOIN customer ON c_nationkey = nation JOIN orders ON o_custkey = c_custkey
    AND (yr IS NULL OR year(o_orderdate) = yr) GROUP BY ALL""")
def year_aware_disjunctive_join(t):
    """A binding without a year holds for all years."""
    binding = t("nation").select(F.col("n_nationkey").alias("nation"), F.when(F.col("n_nationkey") % 3 != 0, 1993 + F.col("n_nationkey") % 5).alias("yr"))
    members = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    met = binding.join(members, (F.col("c_nationkey") == F.col("nation")) & (F.col("yr").isNull() | (F.col("y") == F.col("yr"))))
    return met.groupBy("nation", "yr").agg(F.countDistinct("o_orderkey").alias("n_orders"))


@query("SELECT c_nationkey, count(DISTINCT o_custkey) AS n_members FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY c_nationkey")
def count_distinct_members(t):
    active = t("orders").where("o_orderstatus = 'O'").select("o_custkey").distinct()
    met = t("customer").join(active, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return met.groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("n_members"))


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
def group_count_left_default0(t):
    facts = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return r.counts_or_zero(t("customer").select("c_custkey", "c_name"), facts, "c_custkey")


@query("""SELECT y::INTEGER AS y, count(o_orderkey) AS n FROM range(1990, 2001) d(y) LEFT JOIN (SELECT o_orderkey, year(o_orderdate) AS oy FROM orders WHERE o_orderpriority = '2-HIGH') ON oy = y GROUP BY y""")
def zero_filled_group(t):
    facts = t("orders").where("o_orderpriority = '2-HIGH'").select(F.year("o_orderdate").alias("y"))
    return r.counts_by_range(facts, "y", 1990, 2000)


@query("""WITH s AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'), p AS (SELECT * FROM s ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25)
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM p) = 25 AS has_more FROM p""")
def page_with_total(t):
    rows = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return r.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 25)


@query("""SELECT p_partkey, p_size, p_name, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part QUALIFY place <= 100""")
def priority_sort(t):
    shown = t("part").orderBy(F.desc("p_size"), "p_partkey").limit(100).select("p_partkey", "p_size", "p_name")
    # the hundred rows of the limit, not the table, are numbered in one place
    return shown.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p_size"), "p_partkey")).cast("long"))


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def lastn_messages(t):
    return r.last_n(t("conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query(f"""WITH RECURSIVE {ORGANIZATIONS}, up AS (SELECT node, node AS ancestor, 0 AS distance FROM org WHERE node LIKE 'c%' AND name LIKE '%7'
    UNION ALL SELECT up.node, org.parent, distance + 1 FROM up JOIN org ON org.node = up.ancestor WHERE org.parent IS NOT NULL) SELECT * FROM up""")
def hierarchy_recursive_up(t):
    org = organizations(t)
    return r.ancestors(org, org.where("node LIKE 'c%' AND name LIKE '%7'").select("node"), "node", "parent")


@query(f"""WITH RECURSIVE {ORGANIZATIONS}, up AS (SELECT node, node AS ancestor, 0 AS distance FROM org
    UNION ALL SELECT up.node, org.parent, distance + 1 FROM up JOIN org ON org.node = up.ancestor WHERE org.parent IS NOT NULL) SELECT * FROM up""")
def hierarchy_recursive_up_all(t):
    """Ancestors of every node."""
    org = organizations(t)
    return r.ancestors(org, org.select("node"), "node", "parent")


@query(f"WITH {ORGANIZATIONS} SELECT a.node AS ancestor, count(*) AS n_nodes FROM org a JOIN org d ON d.path = a.path OR d.path LIKE a.path || '/%' GROUP BY a.node")
def hierarchy_closure_down(t):
    """Nodes at or under each node: the prefixes of a path are its ancestors, so the closure is an equality join."""
    org = organizations(t)
    parts = F.split("path", "/")
    prefixes = org.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("above"))
    counted = prefixes.groupBy("above").agg(F.count("*").alias("n_nodes"))
    return org.join(counted, F.col("path") == F.col("above")).select(F.col("node").alias("ancestor"), "n_nodes")


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT o_orderkey, o_orderstatus, o_totalprice, 0 AS v FROM orders
    UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey + 10000000, 'N', 0.0, 1 FROM orders WHERE o_orderkey % 50 = 0)
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC) = 1""")
def upsert_latest(t):
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(0).alias("v"))
    changed = t("orders").where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("v"))
    new = t("orders").where("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"), F.lit(1).alias("v"))
    return r.upsert(rows, changed.union(new), ["o_orderkey"], [F.desc("v")]).drop("v")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_metadata(t):
    gone = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return r.without(t("lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.role, a.role) AS role, coalesce(b.active, a.active) AS active FROM
    (SELECT c_custkey AS k, c_mktsegment AS role, c_acctbal > 0 AS active FROM customer) a FULL JOIN
    (SELECT o_custkey AS k, max(o_orderpriority) AS role, true AS active FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey) b ON a.k = b.k""")
def member_merge(t):
    rows = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("role"), (F.col("c_acctbal") > 0).alias("active"))
    changes = t("orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("role"), F.lit(True).alias("active"))
    return r.merge(rows, changes, ["k"])


@query("""SELECT n_nationkey, n_name, count(DISTINCT c_custkey) AS n_members, count(o_orderkey) AS n_resources, round(coalesce(avg(o_totalprice), 0), 8) AS avg_price
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY ALL""")
def space_listing_agg(t):
    """Listing with counts: each side is aggregated before it is joined."""
    orders = t("orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    members = t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n_members"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    met = t("nation").join(members, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return met.select("n_nationkey", "n_name", F.coalesce("n_members", F.lit(0).cast("long")).alias("n_members"), F.coalesce("n", F.lit(0).cast("long")).alias("n_resources"), F.round(F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)), 8).alias("avg_price"))


@query("""SELECT 'Supplier-' || lpad((max(s_suppkey) + 1)::VARCHAR, greatest(3, length((max(s_suppkey) + 1)::VARCHAR))::INTEGER, '0') AS next_code FROM supplier""")
def next_sequence_code(t):
    number = F.col("s_suppkey").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))  # lpad would cut longer numbers to three digits
    return r.next_code(t("supplier").select(F.concat(F.lit("Supplier-"), padded).alias("code")), "code", "Supplier")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS place FROM documents QUALIFY place <= 5")
def folders_first_sort(t):
    ranked = t("documents").select("doc_id", "source").withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return ranked.where("place <= 5")


@query("""SELECT event_id, last_value(CASE WHEN value >= 10 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""")
def forward_fill(t):
    rows = t("events").select("event_id", "user_id", F.when(F.col("value") >= 10, F.col("value")).alias("value"))
    return r.forward_filled(rows, "user_id", "event_id", "value").select("event_id", "value")


@query(f"""WITH RECURSIVE {ORGANIZATIONS}, gone AS (SELECT node FROM org WHERE node IN ('r1', 'n3') UNION ALL SELECT org.node FROM gone JOIN org ON org.parent = gone.node)
    SELECT 'organizations' AS of_table, count(*) AS n FROM org WHERE node NOT IN (SELECT node FROM gone) UNION ALL SELECT 'orders', count(*) FROM orders WHERE 'c' || o_custkey NOT IN (SELECT node FROM gone)""")
def cascading_delete(t):
    org = organizations(t)
    orders = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("node"), "o_orderkey")
    left = r.without_subtree(org, org.where("node IN ('r1', 'n3')").select("node"), "node", "parent", {"orders": orders})
    counted = lambda name, rows: rows.agg(F.lit(name).alias("of_table"), F.count("*").alias("n"))
    return counted("organizations", left["rows"]).union(counted("orders", left["orders"]))


#: Documents as a tree of sixty at a time: a document's parent is one to three before it.
_DEEP = "docs AS (SELECT doc_id AS node, CASE WHEN doc_id % 60 > doc_id % 3 THEN doc_id - 1 - doc_id % 3 END AS parent FROM documents)"


def deep(t):
    n = F.col("doc_id")
    return t("documents").select(n.alias("node"), F.when(n % 60 > n % 3, n - 1 - n % 3).alias("parent"))


@query(f"WITH RECURSIVE {_DEEP}, up AS (SELECT node, node AS ancestor, 0 AS distance FROM docs UNION ALL SELECT up.node, parent, distance + 1 FROM up JOIN docs ON docs.node = up.ancestor WHERE parent IS NOT NULL) SELECT * FROM up")
def hierarchy_deep_up(t):
    """Ancestors of every node of trees of 30 levels and more."""
    return r.ancestors(deep(t), deep(t).select("node"), "node", "parent")


@query(f"WITH RECURSIVE {_DEEP}, down AS (SELECT node FROM docs WHERE node % 61 = 7 UNION SELECT docs.node FROM down JOIN docs ON docs.parent = down.node) SELECT node FROM down")
def hierarchy_deep_down(t):
    return r.descendants(deep(t), deep(t).where("node % 61 = 7").select("node"), "node", "parent")


@query(f"WITH RECURSIVE {_DEEP}, down AS (SELECT node, node AS root, 1 AS depth FROM docs WHERE parent IS NULL UNION ALL SELECT docs.node, root, depth + 1 FROM down JOIN docs ON docs.parent = down.node) SELECT node, root, depth FROM down")
def hierarchy_depths(t):
    return trees.depths(deep(t), "node", "parent")


_RINGS = "ring AS (SELECT event_id AS node, CASE WHEN event_id % 100 < 30 THEN event_id // 100 * 100 + (event_id % 100 + 1) % 30 WHEN event_id % 100 < 60 THEN event_id - 7 WHEN event_id % 100 < 90 THEN event_id + 1 END AS parent FROM events)"


@query(f"WITH RECURSIVE {_RINGS}, down AS (SELECT node FROM ring WHERE node % 100 < 30 UNION SELECT ring.node FROM down JOIN ring ON ring.parent = down.node) SELECT node FROM down")
def hierarchy_cycles(t):
    """Of a hundred events thirty are a ring, thirty lead into it, thirty are a chain and ten stand alone."""
    n = F.col("event_id") % 100
    parent = F.when(n < 30, F.col("event_id") - n + (n + 1) % 30).when(n < 60, F.col("event_id") - 7).when(n < 90, F.col("event_id") + 1)
    return trees.cyclic(t("events").select(F.col("event_id").alias("node"), parent.alias("parent")), "node", "parent")
