"""Relational operators: predicates, joins, counts, paging and hierarchies.

Each takes and returns DataFrames; nothing is collected. Dimension-like sides are left to the optimizer,
which broadcasts what its statistics show to be small.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.operators.trees import ancestors, descendants

__all__ = ["ancestors", "descendants"]  # hierarchies are read here too


def where_all(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the given values; a value of None asks for null, a list for any of its values."""

    def test(name: str, value) -> Column:
        if value is None:
            return F.col(name).isNull()
        return F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value

    return reduce(lambda r, kv: r.where(test(*kv)), values.items(), rows)


def where_any_path(rows: DataFrame, key: str, *paths: DataFrame | Column) -> DataFrame:
    """Rows that at least one access path admits: a predicate, or a frame of admitted keys (its first column).
    Predicates are one filter; frames are semi-joins on the union of their keys, so that no join is a disjunction."""
    tests = [p for p in paths if isinstance(p, Column)]
    frames = [p.select(F.col(p.columns[0]).alias("__key")) for p in paths if not isinstance(p, Column)]
    admitted = reduce(DataFrame.union, frames).distinct() if frames else None
    test = reduce(Column.__or__, tests) if tests else F.lit(False)
    if admitted is None:
        return rows.where(test)
    flagged = rows.join(admitted.withColumn("__in", F.lit(True)), F.col(key) == F.col("__key"), "left")
    return flagged.where(F.coalesce(test, F.lit(False)) | F.col("__in").isNotNull()).select(*rows.columns)


def search(rows: DataFrame, keyword: str, columns: list[str], order: str, limit: int) -> DataFrame:
    """Rows of which one of the columns contains the keyword in any case (a blank keyword: all), first by order."""
    if keyword.strip():
        pattern = f"%{keyword}%"
        rows = rows.where(reduce(Column.__or__, [F.col(c).ilike(pattern) for c in columns]))
    return rows.orderBy(order).limit(limit)


def with_path(children: DataFrame, key: str, parent: str, parents: DataFrame | None = None, parent_path: str = "path", parent_key: str | None = None) -> DataFrame:
    """Children with their materialized path: the parent's path, a slash and their key."""
    if parents is None:
        return children.withColumn("path", F.col(key).cast("string"))
    above = parents.select(F.col(parent_key).alias("__pk"), F.col(parent_path).alias("__path"))
    return children.join(above, F.col(parent) == F.col("__pk")).withColumn("path", F.concat_ws("/", "__path", F.col(key).cast("string"))).drop("__pk", "__path")


def subtree(rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Rows at or under a path; the prefix test reaches the scan."""
    return rows.where((F.col(path) == root) | F.col(path).startswith(f"{root}/"))


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """Page `number` (from 1) with columns total (rows of all pages) and has_more (the page is full)."""
    size = max(1, min(size, most))
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    full = shown.agg((F.count("*") == size).alias("has_more"))
    return shown.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(full))  # each has one row


def limited(rows: DataFrame, order: list[Column], limit: int = 1000, offset: int = 0, most: int = 1000) -> DataFrame:
    """The first `limit` rows behind the offset, `most` at most, with at_limit: whether `most` rows came, so that the caller sees that a listing without pages may be cut."""
    shown = rows.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, most)))
    reached = shown.agg((F.count("*") >= most).alias("at_limit"))
    return shown.crossJoin(F.broadcast(reached))  # one row


def counts_or_zero(domain: DataFrame, facts: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Each row of domain with the number of facts of its key, 0 where there is none."""
    counted = facts.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    return domain.join(counted, F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce("__n", F.lit(0).cast("long"))).drop("__key", "__n")


def counts_by_range(facts: DataFrame, value: str, low: int, high: int, name: str = "n") -> DataFrame:
    """Counts for each whole value from low to high, zeros included."""
    spark = facts.sparkSession
    return counts_or_zero(spark.range(low, high + 1).select(F.col("id").cast("int").alias(value)), facts.where(F.col(value).between(low, high)), value, name)


def last_n(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the order given (newest first gives the last n)."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("__n") <= n).drop("__n")


def upsert(rows: DataFrame, changes: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """rows and changes (the same columns), of each key the row with the highest version."""
    return last_n(rows.unionByName(changes), key, version, 1)


def without(rows: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among the removed ones: delete by id or by metadata."""
    return rows.join(removed.select(*key).distinct(), key, "left_anti")


def merge(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge by key: values of changes win where they are not null (re-activation, partial updates)."""
    others = [c for c in rows.columns if c not in key]
    new = changes.select(*key, *[F.col(c).alias(f"__{c}") for c in others])
    return rows.join(new, key, "full").select(*key, *[F.coalesce(f"__{c}", c).alias(c) for c in others])


def next_code(rows: DataFrame, code: str, prefix: str, width: int = 3) -> DataFrame:
    """The next code PREFIX-nnn after the largest number in use (as a number, so that it goes on past 999)."""
    number = F.regexp_extract(code, f"^{prefix}-(\\d+)$", 1)
    largest = rows.where(number != "").agg(F.coalesce(F.max(number.cast("int")), F.lit(0)).alias("n"))
    digits = (F.col("n") + 1).cast("string")
    return largest.select(F.concat(F.lit(f"{prefix}-"), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)).alias("next_code"))


def without_subtree(rows: DataFrame, start: DataFrame, key: str, parent: str, dependents: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A cascading delete: what is left of rows ("rows") and of each dependent table, by its name, whose column of the name `key` refers to a
    removed row."""
    gone = descendants(rows, start, key, parent)
    tables = {"rows": rows} | (dependents or {})
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def deactivated(rows: DataFrame, revoked: DataFrame, key: list[str], flag: str = "is_active") -> DataFrame:
    """rows with the flag false where their key is among the revoked (null equals null); the others stay as they are, and nothing is removed."""
    names = [f"__{c}" for c in key]
    gone = revoked.select(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)]).distinct().withColumn("__gone", F.lit(True))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names, strict=True)])
    return rows.join(gone, same, "left").withColumn(flag, F.when(F.col("__gone"), F.lit(False)).otherwise(F.col(flag))).select(*rows.columns)


def archived(rows: DataFrame, start: DataFrame, key: str, parent: str, at: Column) -> DataFrame:
    """rows with status, archived_at and error: those at and below the nodes of start become `archived` at that time, without an error; their chunks are
    what without(chunks, …) takes out by the ids of `descendants`."""
    inside = F.col("__k").isNotNull()
    met = rows.join(descendants(rows, start, key, parent).select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left")
    return met.withColumns({"status": F.when(inside, "archived").otherwise(F.col("status")), "archived_at": F.when(inside, at).otherwise(F.col("archived_at")), "error": F.when(~inside, F.col("error"))}).drop("__k")


def restored(rows: DataFrame, start: DataFrame, key: str, parent: str, is_folder: Column, has_file: Column, missing: str = "no file") -> DataFrame:
    """rows with status, archived_at and error: of those at and below the nodes of start, folders are a `success` again, files `processing` (their chunks
    are made anew) and no longer archived, or `failed` with an error, and still archived, where their file is missing."""
    inside, lost = F.col("__k").isNotNull(), ~is_folder & ~F.coalesce(has_file, F.lit(False))
    met = rows.join(descendants(rows, start, key, parent).select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left")
    status = F.when(is_folder, "success").when(lost, "failed").otherwise("processing")
    return met.withColumns({"status": F.when(inside, status).otherwise(F.col("status")), "archived_at": F.when(~inside | lost, F.col("archived_at")), "error": F.when(inside, F.when(lost, missing)).otherwise(F.col("error"))}).drop("__k")


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by a hash of their key: the same ones at every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def forward_filled(rows: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """Blank and null cells take the last value above them (merged cells of a table)."""
    above = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), ignorenulls=True).over(above) for c in columns})


def reading_order(blocks: DataFrame, page: str, x: str = "x", y: str = "y", text: str = "text") -> DataFrame:
    """page, text: recognised blocks joined by lines from top to bottom and left to right, without one that repeats the one before."""
    order = Window.partitionBy(page).orderBy(y, x, text)
    kept = blocks.withColumn("__b", F.lag(text).over(order)).where(F.col("__b").isNull() | (F.col("__b") != F.col(text)))
    lines = kept.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(y, x, text))).alias("__l"))
    return lines.select(page, F.array_join(F.transform("__l", lambda l: l[text]), "\n").alias(text))
