"""Operators over tables of texts: copies, similar pairs, contents."""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.sources.folders import written


def exact_copies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """first_id, n_copies, last_id of each text that more than one row has; hashes are shuffled, not texts."""
    groups = rows.groupBy(F.sha2(text, 256).alias("h")).agg(F.min(key).alias("first_id"), F.count("*").alias("n_copies"), F.max(key).alias("last_id"))
    return groups.where("n_copies > 1").select("first_id", "n_copies", "last_id")


def shingles(rows: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, n (number of distinct shingles) and h (hash) of each distinct shingle of `words` words; shorter texts have none."""
    tokens = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")
    places = F.when(F.size("w") >= words, F.sequence(F.lit(1), F.size("w") - (words - 1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    return rows.select(key, tokens.alias("w")).select(key, F.array_distinct(hashes).alias("h")).select(key, F.size("h").alias("n"), F.explode("h").alias("h"))


#: Shingles that are met at once where their numbers are looked at, and shingles at most whose numbers go to all tasks (16 MB).
AT_ONCE, FREQUENT = 1 << 21, 1_000_000


class _Words(dict):
    """The hash of each word, looked up; forgotten where there are too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = number = xxhash.xxh64_intdigest(word)
        return number


def _shingled(texts: Iterator[str | None], words: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles, rising: sums of their words' hashes by odd random factors. Texts are in lower case, and cut at ASCII white space."""
    known, factor = _Words(), np.random.default_rng(42).integers(0, 2**64, words, dtype=np.uint64) | np.uint64(1)
    for text in texts:
        tokens = (text or "").encode("utf-8", "surrogatepass").split()
        number = max(0, len(tokens) - words + 1)
        each = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        sums = np.zeros(number, dtype=np.uint64)
        for place in range(words if number else 0):
            sums += each[place : place + number] * factor[place]
        sums = (sums ^ (sums >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)  # mixed: they are ordered by
        yield np.unique(sums ^ (sums >> np.uint64(29)))


def _frequent(words: int):
    """h, count of the shingles that several of some texts read together have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h, number = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[number > 1].view(np.int64)), pa.array(number[number > 1])], names=["h", "count"])

        for batch in batches:
            for own in _shingled((t.as_py() for t in batch.column("t")), words):
                held.append(own)
                size += len(own)
                if size >= AT_ONCE:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return run


def _sets(words: int, named: list[str], shared=None, least: float = 0.0):
    """The named columns, n (number of distinct shingles) and s: the first n - ceil(least n) + 1 of them, those that `shared` doesn't know
    by their hashes, before the others by their numbers; without shared all, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, number = shared.value if shared else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))

        def first(own: np.ndarray) -> np.ndarray:
            length = len(own) - math.ceil(least * len(own) - 1e-9) + 1 if len(own) else 0
            if len(h):
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                own = own[np.argsort(np.where(h[at] == own, number[at], 0), kind="stable")]
            return own[:length]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(_shingled(part.column("t").to_pylist(), words))
                s = pa.array([(first(own) if shared else own).view(np.int64) for own in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*map(part.column, named), pa.array([len(own) for own in found], pa.int32()), s], names=[*named, "n", "s"])

    return run


def similar_pairs(rows: DataFrame, key: str, text: str, words: int = 5, least: float = 0.8) -> DataFrame:
    """a < b, similarity of distinct texts (each named by its least key) whose shingle sets have Jaccard similarity `least` or more.

    Prefix filter: in whatever order shingles are, if it is one for all texts, two sets that similar share one of the first
    n - ceil(least n) + 1 of each. Only these prefixes are shuffled and joined, and only pairs of similar sizes; then the
    whole sets of the candidates are made from their texts and compared. The order is that of the shingles' hashes, behind which come, by their numbers, those that many texts have:
    a first reading counts what comes several times in some texts read together, which needs no shuffle of shingles. Numbers that are too small make more
    candidates, never other pairs. A shingle that only one prefix has goes no further.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)[key]
    texts = rows.select(F.col(key).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.lower(text).alias("t"))
    counted = texts.select("t").mapInArrow(_frequent(words), "h long, count long").groupBy("h").agg(F.sum("count").alias("count")).where("count > 8")
    often = counted.orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, number = often.column("h").to_numpy().view(np.uint64), often.column("count").to_numpy()
    shared = spark.sparkContext.broadcast((h[order := np.argsort(h)], number[order]))

    named = f"id {kind}, digest binary, n int, s array<long>"
    first = texts.mapInArrow(_sets(words, ["id", "digest"], shared, least), named)
    # one row of each text; those of null texts and of too few words have no shingle
    once = written(first.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("s").alias("s")).where("id IS NOT NULL AND n > 0"), "prefixes")
    prefix = once.select("id", "n", F.explode("s").alias("h")).withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    x, y = prefix.hint("merge").alias("x"), prefix.hint("merge").alias("y")
    near = (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.n") >= F.col("y.n") * least - 1e-9) & (F.col("y.n") >= F.col("x.n") * least - 1e-9)
    held = x.join(y, near).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("m"), F.col("y.n").alias("n")).agg(F.count("*").alias("both"))
    # of one of two prefixes, that which ends first, all common shingles are in the other: what is not among them is behind that prefix
    behind = lambda n: F.ceil(F.lit(least) * F.col(n) - 1e-9) - 1
    pairs = held.where(F.col("both") + F.greatest(behind("m"), behind("n")) >= least / (1 + least) * (F.col("m") + F.col("n")) - 1e-6).select("a", "b")

    asked = once.select("id", "digest").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    sets = texts.join(asked, ["id", "digest"], "left_semi").select("id", "t").mapInArrow(_sets(words, ["id"]), f"id {kind}, n int, s array<long>").groupBy("id").agg(F.first("n").alias("n"), F.first("s").alias("s"))
    met = pairs.join(sets.toDF("a", "na", "sa"), "a").join(sets.toDF("b", "nb", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return met.select("a", "b", (common / (F.col("na") + F.col("nb") - common)).alias("similarity")).where(F.col("similarity") >= least)


def contents(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, stride: int = 30, upto: int = 100, block: int = 20000) -> DataFrame:
    """doc_key, item_key of the items of which a full piece of `stride` characters (line feeds and blanks not counted) is in a document.

    The items are the stated query set: blocks of about `block` of them go to all tasks, one after the other, as a
    table of their pieces, in which each window of a document is looked up where the document is read.
    """
    squeeze = lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))
    starts = F.sequence(F.lit(0), F.lit((upto - 1) // stride))
    wanted = items.where(F.col(item_key).isNotNull()).select(item_key, F.substring(squeeze(F.col("text")), 1, upto).alias("t"))
    pieces = wanted.select(item_key, F.explode(F.transform(starts, lambda i: F.substring("t", i * stride + 1, F.lit(stride)))).alias("piece")).where(F.length("piece") == stride).distinct()
    kinds = dict(docs.dtypes) | {f"item {c}": k for c, k in items.dtypes}
    schema = f"{doc_key} {kinds[doc_key]}, {item_key} {kinds[f'item {item_key}']}"
    parts, found = max(1, -(-items.count() // block)), []
    for part in range(parts):
        table: dict[str, list] = {}
        for row in pieces.where(F.pmod(F.xxhash64(item_key), F.lit(parts)) == part).collect():
            table.setdefault(row["piece"], []).append(row[item_key])
        shared = docs.sparkSession.sparkContext.broadcast(table)
        found.append(docs.select(doc_key, squeeze(F.col("text")).alias("t")).mapInPandas(_holding(shared, doc_key, item_key, stride), schema))
    return reduce(DataFrame.union, found)


#: Of a window's number (32 bits) so many are looked at first.
TOP_BITS = 20


def window_numbers(text: str, width: int) -> np.ndarray:
    """A number of 32 bits for each window of `width` characters, of the numbers of two windows that follow each other for twice the width at each step;
    equal windows have equal numbers."""
    level = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    number = max(0, len(level) - width + 1)
    power = lambda n: np.uint32(pow(0x9E3779B1, n, 2**32))
    out, done, size = np.zeros(number, dtype=np.uint32), 0, 1
    while done < width:
        if width & size:
            out += level[done : done + number] * power(done)
            done += size
        level = level[:-size] + level[size:] * power(size)
        size *= 2
    return out


def _together(ids, texts, characters: int = 1 << 16):
    """Lists of ids and texts that follow each other, of about so many characters in all; null texts are left out."""
    some_ids, some, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        if t is not None:
            some_ids.append(i)
            some.append(t)
            size += len(t)
        if size >= characters:
            yield some_ids, some
            some_ids, some, size = [], [], 0
    if some:
        yield some_ids, some


def _holding(shared, doc_key: str, item_key: str, stride: int):
    def run(batches):
        own = shared.value
        known = np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *(window_numbers(piece, stride) for piece in own)]))
        some = np.zeros(1 << TOP_BITS, dtype=bool)  # most windows are told apart by their numbers' first bits
        some[known >> (32 - TOP_BITS)] = True
        for batch in batches:
            rows = []
            for ids, texts in _together(batch[doc_key], batch["t"]) if len(known) else ():
                text = "\n".join(texts)  # no piece holds a line feed, so none is found across two texts
                numbers = window_numbers(text, stride)
                near = np.flatnonzero(some.take(numbers >> (32 - TOP_BITS)))
                near = near[known[np.minimum(np.searchsorted(known, numbers[near]), len(known) - 1)] == numbers[near]]
                ends = np.cumsum([len(t) + 1 for t in texts])
                met = {(n, i) for at, n in zip(near.tolist(), np.searchsorted(ends, near, "right").tolist(), strict=True) for i in own.get(text[at : at + stride], ())}
                rows += [(ids[n], i) for n, i in sorted(met)]
            yield pd.DataFrame(rows, columns=[doc_key, item_key])

    return run


def containing(rows: DataFrame, text: str, needles: DataFrame, name: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """rows beside the needles whose name their text contains (and whose columns `scope` are equal). Blank and null names are contained in nothing.

    A name meets texts by its rarest part of three characters (or as many as it has), by equality; what meets is then looked at. So no text is compared with all
    names, and neither side is sent to all tasks. Texts should be short ones: they are indexed by all of their parts.
    """
    at = F.sequence(F.lit(1), F.length(text))
    parts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.substring(text, i, n)))))
    held = rows.where(F.length(text) > 0).withColumn("__part", F.explode(parts))
    often = held.groupBy(*scope, "__part").agg(F.count("*").alias("__n"))
    wanted = needles.select(*scope, F.col(name).alias("__name")).where(F.trim("__name") != "").distinct()
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__name") - 2)), lambda i: F.substring("__name", i, F.lit(3)))
    rarest = wanted.withColumn("__part", F.explode(own)).join(often, [*scope, "__part"]).groupBy(*scope, "__name").agg(F.min(F.struct("__n", "__part")).alias("__r")).select(*scope, "__name", F.col("__r.__part").alias("__part"))
    met = held.join(rarest, [*scope, "__part"]).where(F.contains(F.col(text), F.col("__name"))).drop("__part")
    return met.join(needles.withColumn("__name", F.col(name)), [*scope, "__name"]).drop("__name")
