"""Tables and text of pages from placed words: what a PDF parser sees, as joins and windows.

words: page, x0, x1, top, bottom, text. boxes: page, table, x0, top, x1, bottom (where a table lies on the page; table is its number there). A page is a bounded group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """words with table: the box of their page in which their middle lies (of several the first), null outside of all."""
    # boxes are gathered by page: a page has few, and its words meet them by equality, once
    held = boxes.groupBy(F.col("page").alias("__page")).agg(F.array_sort(F.collect_list(F.struct("table", "x0", "top", "x1", "bottom"))).alias("__b"))
    met = words.join(held, F.col("page") == F.col("__page"), "left")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    first = F.get(F.filter("__b", lambda b: x.between(b["x0"], b["x1"]) & y.between(b["top"], b["bottom"])), F.lit(0))["table"]
    return met.withColumn("table", first).drop("__page", "__b")


def _clusters(rows: DataFrame, by: list[str], value: Column, gap: Column | float, name: str) -> DataFrame:
    """rows with name: the number (from 0) of their cluster along a value; a value further than gap from the one before begins a new cluster."""
    order = Window.partitionBy(*by).orderBy("__v")
    marked = rows.withColumn("__v", value).withColumn("__new", (F.col("__v") - F.lag("__v").over(order) > gap).cast("int"))
    return marked.withColumn(name, F.sum(F.coalesce("__new", F.lit(0))).over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__v", "__new")


def cells(words: DataFrame, boxes: DataFrame, word_gap: float = 8.0, row_gap: float = 4.0, column_gap: float = 8.0) -> DataFrame:
    """page, table, row, col, text of the tables' cells, all columns in each row.

    Words whose middles are at most row_gap apart are a row; words of a row at most word_gap apart are a cell, its text joined by blanks; cells that begin at most column_gap
    apart are a column. A cell that is blank, as merged ones are below their first row and beside their first column, takes the text above it.
    """
    of_table = ["page", "table"]
    placed = inside(words, boxes).where("table IS NOT NULL").where(F.trim("text") != "")
    rows = _clusters(placed, of_table, (F.col("top") + F.col("bottom")) / 2, row_gap, "row")
    along = Window.partitionBy(*of_table, "row").orderBy("x0", "x1", "text")
    starts = rows.withColumn("__start", F.coalesce((F.col("x0") - F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1)) > word_gap).cast("int"), F.lit(1)))
    parts = starts.withColumn("__cell", F.sum("__start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.groupBy(*of_table, "row", "__cell").agg(F.min("x0").alias("x0"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: F.trim(w["text"])), " ").alias("text"))
    found = _clusters(joined, of_table, F.col("x0"), column_gap, "col").groupBy(*of_table, "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda c: c["text"]), " ").alias("text"))
    size = found.groupBy(*of_table).agg(F.max("row").alias("r"), F.max("col").alias("c"))
    grid = size.select(*of_table, F.explode(F.sequence(F.lit(0), F.col("r"))).alias("row"), "c").select(*of_table, "row", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("col"))
    above = Window.partitionBy(*of_table, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(found, [*of_table, "row", "col"], "left").withColumn("text", F.coalesce(F.last("text", ignorenulls=True).over(above), F.lit("")))


def page_texts(words: DataFrame, boxes: DataFrame, row_gap: float = 4.0, **options) -> DataFrame:
    """page, text of each page with words: its tables as Markdown, in their order, then its other lines from top to bottom; parts are separated by an empty line."""
    bar = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    lines = cells(words, boxes, row_gap=row_gap, **options).groupBy("page", "table", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", F.replace("text", F.lit("|"), F.lit("\\|")).alias("text")))), lambda c: c["text"]).alias("c"))
    rule = F.concat(F.lit("\n"), bar(F.transform("c", lambda _: F.lit("---"))))
    lines = lines.select("page", "table", "row", F.concat(bar(F.col("c")), F.when(F.col("row") == 0, rule).otherwise("")).alias("line"))
    tables = lines.groupBy("page", "table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("part"))
    outside = inside(words, boxes).where("table IS NULL").where(F.trim("text") != "")
    spoken = _clusters(outside, ["page"], (F.col("top") + F.col("bottom")) / 2, row_gap, "row").groupBy("page", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: F.trim(w["text"])), " ").alias("line"))
    other = spoken.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("part"))
    parts = tables.select("page", F.struct(F.lit(0).alias("k"), "table", "part").alias("p")).union(other.select("page", F.struct(F.lit(1).alias("k"), F.lit(None).cast(dict(tables.dtypes)["table"]).alias("table"), "part").alias("p")))
    return parts.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "\n\n").alias("text"))
