"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is the number of > that it begins with. A passage is a run of lines of one level
without blank lines between them. Quoted passages and their lines of every level, normalised (lower case, single
blanks), are hashed and joined to the latest earlier message of the conversation that holds the same passage or
line as its own text. A message answers the message that its quotes of the lowest level that links
link to most (by characters, then the later one); without links, the message before it. Parents come before their
replies, so place, the order by turn, is a reply order; depth counts the replies above a message.

Messages are numbered over ranges of (conversation, turn, role, text) of like size, and sources are looked up in
blocks of places, so that a conversation that holds a third of all messages is spread over tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.common import cut

_PREFIX = r"^(?:[ \t]*>)+"
#: The line above a quote that names its author, in English, German, French and Spanish.
_INTRODUCES = r"(?i)^\s*(on|am|le|el)\s.*(wrote|schrieb|écrit|escribió).*:\s*$"
PLACES = 1024


def numbered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with place (from 1, by turn, role and text, nulls first) and before (the turn of the
    message at the place before)."""
    order = ["conv_id", "turn", "role", "text"]
    rows = cut(messages.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.max("last").over(earlier).alias("last"))
    within = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    own = rows.withColumn("n", F.row_number().over(within)).withColumn("before", F.lag("turn").over(within))
    met = own.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return met.select("conv_id", "turn", "role", "text", (F.col("start") + F.col("n")).cast("long").alias("place"), F.when(F.col("n") == 1, F.col("last")).otherwise(F.col("before")).alias("before"))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 0), "[^>]", ""))


def units(messages: DataFrame) -> DataFrame:
    """conv_id, place, level, h, size of each distinct passage and line of the messages (numbered)."""
    lines = messages.select("conv_id", "place", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("level", _level(F.col("line")))
    lines = lines.withColumn("words", F.btrim(F.lower(F.regexp_replace(F.regexp_replace("line", _PREFIX, ""), r"\s+", " ")))).where("words <> ''")
    order = Window.partitionBy("conv_id", "place").orderBy("pos")
    breaks = F.when((F.lag("pos").over(order) == F.col("pos") - 1) & (F.lag("level").over(order) == F.col("level")), 0).otherwise(1)
    runs = lines.withColumn("new", breaks).withColumn("run", F.sum("new").over(order))
    passages = runs.groupBy("conv_id", "place", "level", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"]), " ").alias("words"))
    both = lines.select("conv_id", "place", "level", "words").union(passages.select("conv_id", "place", "level", "words"))
    return both.select("conv_id", "place", "level", F.xxhash64("words").alias("h"), F.length("words").alias("size")).distinct()


def unquoted(text: Column) -> Column:
    """The message's own lines: no quotes, no line that introduces one, no line breaks at the ends."""
    lines = F.split(text, "\n")
    quoted = lambda i: F.coalesce(F.get(lines, i).rlike(_PREFIX), F.lit(False))
    own = F.filter(lines, lambda line, i: ~line.rlike(_PREFIX) & ~(line.rlike(_INTRODUCES) & quoted(i + 1)))
    return F.btrim(F.array_join(own, "\n"), F.lit("\n"))


def linked(found: DataFrame) -> DataFrame:
    """conv_id, place, level, h, size, source of each quoted unit of which an earlier message holds the words as its own: the latest such."""
    rows = found.select("conv_id", "h", "size", "place", "level", F.floor(F.col("place") / PLACES).alias("block"), F.when(F.col("level") == 0, F.col("place")).alias("source"))
    key = ["conv_id", "h", "size"]
    ends = rows.groupBy(*key, "block").agg(F.max("source").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"{c}_") for c in [*key, "block"]], F.max("last").over(earlier).alias("carried"))
    # At one place quotes come before own text: a message doesn't quote itself.
    within = Window.partitionBy(*key, "block").orderBy("place", F.col("source").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("near", F.last("source", ignorenulls=True).over(within)).where("level > 0")
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_"))
    for c in ["h", "size", "block"]:
        same = same & (F.col(c) == F.col(f"{c}_"))
    return near.join(carried, same).withColumn("source", F.coalesce("near", "carried")).where("source IS NOT NULL").select("conv_id", "place", "level", "h", "size", "source")


def depths(parents: DataFrame) -> DataFrame:
    """conv_id, place, depth of rows conv_id, place, parent (null: none; a smaller place): the number of ancestors, by pointers that
    double their reach in each round."""
    state = cut(parents.select("conv_id", "place", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("conv_id").alias("c"), F.col("place").alias("p"), F.col("up").alias("next"), F.col("depth").alias("more"))
        met = state.where("up IS NOT NULL").join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("p")))
        state = cut(met.select("conv_id", "place", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")).union(state.where("up IS NULL")))
    return state.select("conv_id", "place", "depth")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, place, reply_to (turn of the message answered), depth, own_text, n_quoted (lines), max_level, n_linked
    (distinct quoted passages and lines found in an earlier message) and linked_level (the level whose links decide; 0 without)
    for each row of messages.

    A null conv_id is a conversation of its own; null turns come first. A null text has no lines and stays
    null. Repeated rows are messages of their own. An empty table gives an empty result; other columns
    are ignored.
    """
    rows = cut(numbered(messages))
    links = cut(linked(cut(units(rows))))
    weighed = links.groupBy("conv_id", "place", "level", "source").agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    parents = weighed.groupBy("conv_id", "place").agg(F.max(F.struct((-F.col("level")).alias("level"), "weight", "source")).alias("best"), F.sum("n").alias("n_linked"))
    parents = parents.select(F.col("conv_id").alias("c"), F.col("place").alias("p"), F.col("best.source").alias("source"), (-F.col("best.level")).alias("linked_level"), "n_linked")
    turns = rows.select(F.col("conv_id").alias("tc"), F.col("place").alias("tp"), F.col("turn").alias("source_turn"))
    parents = parents.join(turns, F.col("c").eqNullSafe(F.col("tc")) & (F.col("source") == F.col("tp"))).select("c", "p", "source", "source_turn", "linked_level", "n_linked")
    met = cut(rows.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left"))
    deep = depths(met.select("conv_id", "place", F.coalesce("source", F.when(F.col("place") > 1, F.col("place") - 1)).alias("parent"))).toDF("dc", "dp", "depth")
    lines, zero = F.split("text", "\n"), F.lit(0).cast("long")
    return met.join(deep, F.col("conv_id").eqNullSafe(F.col("dc")) & (F.col("place") == F.col("dp"))).select(
        "conv_id", "turn", "role", "place", F.when(F.col("p").isNotNull(), F.col("source_turn")).otherwise(F.col("before")).alias("reply_to"), "depth", unquoted(F.col("text")).alias("own_text"),
        F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(_PREFIX))).cast("long"), zero).alias("n_quoted"), F.coalesce(F.array_max(F.transform(lines, _level)).cast("long"), zero).alias("max_level"),
        F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce(F.col("linked_level").cast("long"), zero).alias("linked_level"),
    )
