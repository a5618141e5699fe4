"""Hierarchies of any depth as adjacency lists (a key and its parent's key).

Pointers are doubled: after n rounds a node's pointer is its ancestor 2ⁿ steps up, so that a chain of a million nodes takes twenty joins and
none of them is a level. Rounds end at a fixed point, never at a depth. A round's rows are written to the shared folder, so
that no plan grows and a lost executor costs its tasks only.

Cycles: if as many nodes have an ancestor 2ⁿ⁺¹ steps up as have one 2ⁿ steps up, all of these lead into a cycle, as the ancestors of a node of finite
depth have every smaller depth. A node of a cycle is below and above all others of it. Null keys take no part; a parent without a row of its own is an
ancestor, and has none; repeated rows count once; keys with several parents are allowed (each path counts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.sources.folders import written


def _edges(rows: DataFrame, key: str, parent: str) -> DataFrame:
    return rows.select(F.col(key).alias("k"), F.col(parent).alias("p")).where("k IS NOT NULL").distinct()


def _fixed_point(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Doubles the pointers p of a state (k, p, …) until none is left, or only those that go round in cycles."""
    before = None
    while True:
        state = written(state, "pointers")
        left = state.where("p IS NOT NULL").agg(F.count_distinct("k")).first()[0]
        if left in (0, before):
            return state
        before, state = left, step(state)


def _jump(state: DataFrame, *carried: str) -> DataFrame:
    """Each pointer beside the pointer of what it points to (p2), whose other columns get a 2 as well; nulls where there is no such row."""
    above = state.select(F.col("k").alias("k2"), F.col("p").alias("p2"), *[F.col(c).alias(f"{c}2") for c in carried])
    return state.join(above, F.col("p") == F.col("k2"), "left")


def descendants(rows: DataFrame, start: DataFrame, key: str, parent: str) -> DataFrame:
    """The ids (column `key`) at and below the nodes of start (its first column), each once.

    A node carries whether one of the ancestors that its pointer has passed is among the nodes of start: n rows a round, however many lie below whatever node.
    """
    wanted = start.select(F.col(start.columns[0]).alias("s")).where("s IS NOT NULL").distinct()
    state = _edges(rows, key, parent).join(wanted, F.col("p") == F.col("s"), "left").select("k", F.when(F.col("s").isNull(), F.col("p")).alias("p"), F.col("s").isNotNull().alias("hit"))

    def step(now: DataFrame) -> DataFrame:
        hit = F.col("hit") | F.coalesce("hit2", F.lit(False))
        return _jump(now, "hit").select("k", F.when(~hit, F.col("p2")).alias("p"), hit.alias("hit")).distinct()

    below = _fixed_point(state, step).where("hit").select(F.col("k").alias(key))
    return below.union(wanted.select(F.col("s").alias(key))).distinct()


def ancestors(rows: DataFrame, start: DataFrame, key: str, parent: str) -> DataFrame:
    """node, ancestor, distance of the nodes of start (its first column) and all above them, themselves at distance 0; one row a pair, with the least distance."""
    jumps = _edges(rows, key, parent).where("p IS NOT NULL")
    node = start.select(F.col(start.columns[0]).alias("node")).where("node IS NOT NULL").distinct()
    found = node.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    reach, before, total, least = 1, None, None, []
    while True:
        jumps = written(jumps, "jumps")
        left = jumps.agg(F.count_distinct("k")).first()[0]
        new = written(found.join(jumps, F.col("ancestor") == F.col("k")).select("node", F.col("p").alias("ancestor"), (F.col("distance") + reach).cast("int").alias("distance")), "ancestors")
        if new.isEmpty():
            return found
        found = found.union(new)
        if left == before or least:  # cycles: only new pairs count from now on
            least.append(True)
            found = written(found.groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "ancestors")
            if (number := found.count()) == total:
                return found
            total = number
        jumps = jumps.join(jumps.toDF("k2", "p2"), F.col("p") == F.col("k2")).select("k", F.col("p2").alias("p")).distinct()
        before, reach = left, 2 * reach


def depths(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """node, root, depth (1: a root) of each node; nulls for nodes that lead to a parent without a row, or into a cycle. Keys have one parent each."""
    edges = _edges(rows, key, parent)
    has_parent = F.col("p").isNotNull()
    state = edges.select("k", "p", F.col("k").alias("root"), F.lit(1).alias("depth"))
    state = state.withColumns({"root": F.when(has_parent, F.col("p")).otherwise(F.col("k")), "depth": F.when(has_parent, 2).otherwise(1)})

    def step(now: DataFrame) -> DataFrame:
        lost = F.col("p").isNotNull() & F.col("k2").isNull()
        moved = F.col("k2").isNotNull()
        root = F.when(moved, F.col("root2")).when(~lost, F.col("root"))
        depth = F.when(moved, F.col("depth") + F.col("depth2") - 1).when(~lost, F.col("depth"))
        return _jump(now, "root", "depth").select("k", "p2", root.alias("root"), depth.alias("depth")).withColumnRenamed("p2", "p")

    done = _fixed_point(state, step)
    ended = F.col("p").isNull()
    return done.select(F.col("k").alias("node"), F.when(ended, F.col("root")).alias("root"), F.when(ended, F.col("depth")).cast("int").alias("depth"))


def cyclic(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """The ids (column `key`) from which the way up never ends: those of cycles, and all below them."""
    done = _fixed_point(_edges(rows, key, parent), lambda now: _jump(now).select("k", F.col("p2").alias("p")).distinct())
    return done.where("p IS NOT NULL").select(F.col("k").alias(key)).distinct()
