"""Retrieval over many documents for many queries at once: lexical and vector top-k, fusion, cuts, diversification.

A result has query_id, an id and a score; every ranking ends with the id, so that it is the same at every
run. Ranks are row numbers over a query, which Spark cuts before its shuffle (window group limit), so that
a query's candidates never meet in one task in full.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions import text as text_functions
from corvine.functions import vectors as v
from corvine.sources.folders import written
from corvine.sources.tables import spread

#: Queries that are sent to every task at a time.
BROADCAST_ROWS = 10000

#: Rows of an Arrow batch that are looked at at a time: what Python makes of a batch is bounded by these and not by the batch's size.
ROWS_AT_A_TIME = 500


def _some_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
            yield batch.slice(at, ROWS_AT_A_TIME)


def top(rows: DataFrame, k: int, *order: Column, by: str = "query_id", rank: str | None = None) -> DataFrame:
    """The first k rows of each query; rank names a column with the place, from 1."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= k)
    return ranked.withColumnRenamed("__n", rank) if rank else ranked.drop("__n")


def best(rows: DataFrame, k: int, score: str = "score", key: str = "chunk_id", rank: str | None = None) -> DataFrame:
    return top(rows, k, F.desc(score), F.asc(key), rank=rank)


# ---- lexical

def postings(docs: DataFrame, key: str, text: str = "text", tokens=text_functions.words) -> DataFrame:
    """term, key, tf, len: the inverted index of the whole texts; len counts the tokens of a text."""
    found = docs.select(F.col(key), tokens(F.col(text)).alias("__w")).select(key, F.size("__w").alias("len"), F.explode("__w").alias("term"))
    return found.groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, tokens=text_functions.words) -> DataFrame:
    """query_id, term, qtf of the queries' tokens."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def in_blocks(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], block: int = BROADCAST_ROWS) -> DataFrame:
    """The answers to all queries, taken in blocks of about `block` (by a hash of query_id), fewer where texts are longer than
    1000 characters: what is made of a block is small enough to be sent to all tasks."""
    size = F.sum(F.length("text")) / 1000 if "text" in queries.columns else F.lit(0)
    number, thousands = queries.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    parts = max(1, -(-number // block), -(-int(thousands) // block))
    return reduce(DataFrame.union, [answer(queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)) for part in range(parts)])


@dataclass
class Asked:
    """A block of queries by their terms: what each task needs to score a document in its own row."""

    ids: list
    kind: str  # their type
    terms: pa.Array
    starts: np.ndarray  # term t is in the queries at[starts[t]:starts[t + 1]], ...
    at: np.ndarray
    counts: np.ndarray  # ... so often
    sequences: list[np.ndarray]  # each query's terms in order

    @staticmethod
    def of(asked: DataFrame, tokens) -> "Asked":
        rows = asked.select("query_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0).toArrow().combine_chunks()
        words = pa.concat_arrays(rows.column("w").chunks) if rows.num_rows else pa.array([], pa.list_(pa.string()))
        coded = words.flatten().dictionary_encode()
        query, term = np.repeat(np.arange(rows.num_rows), words.value_lengths().to_numpy(zero_copy_only=False)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, counts = np.unique(term * max(1, rows.num_rows) + query, return_counts=True)
        size = len(coded.dictionary)
        starts = np.searchsorted(pairs // max(1, rows.num_rows), np.arange(size + 1))
        return Asked(rows.column("query_id").to_pylist(), dict(asked.dtypes)["query_id"], coded.dictionary, starts, pairs % max(1, rows.num_rows), counts, np.split(term, np.flatnonzero(np.diff(query)) + 1) if len(term) else [])

    def held(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of documents' words: each one's number of words, and document, term and count of what they hold of the terms."""
        length = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = self.numbers(words)
        document = np.repeat(np.arange(len(length)), length)[found >= 0]
        pairs, n = np.unique(document * max(1, len(self.terms)) + found[found >= 0], return_counts=True)
        return length, pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms)), n

    def numbers(self, words: pa.ListArray) -> np.ndarray:
        return pc.index_in(words.flatten(), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def summed(self, document: np.ndarray, term: np.ndarray, weight: np.ndarray, by_count: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document, query and sum of the weights of the terms that they share (times the query's count of a term), some documents at a time."""
        width = max(1, len(self.ids))
        step = max(1, (1 << 21) // width)
        for first in range(0, int(document.max()) + 1 if len(document) else 0, step):
            low, high = np.searchsorted(document, [first, first + step])
            t = term[low:high]
            many = self.starts[t + 1] - self.starts[t]
            reads = np.repeat(self.starts[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
            value = np.repeat(weight[low:high], many) * (self.counts[reads] if by_count else 1)
            where = np.repeat(document[low:high] - first, many) * width + self.at[reads]
            sums = np.bincount(where, value, minlength=0)
            some = np.flatnonzero(sums > 0)
            yield some // width + first, some % width, sums[some]


Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def scored_in_tasks(rows: DataFrame, key: str, asked: Asked, k: int, score: Callable[[Asked, pa.RecordBatch], Found]) -> DataFrame:
    """query_id, key, score: the k best documents of each query. `score` gives document, query and score over a batch of rows, which have key and
    what it needs. A document is scored where it is read, and a task hands on its k best of each query: no (query, document) row is shuffled else."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    kind = dict(rows.dtypes)[key]

    def run(batches):
        own, best_rows = shared.value, None
        edge = np.zeros(len(own.ids))
        for batch in _some_at_a_time(batches):
            parts = []
            for document, query, value in score(own, batch):
                value = np.round(value, 6)
                some = (value > 0) & (value >= edge[query])
                parts.append((document[some], query[some], value[some]))
            document, query, value = (np.concatenate([np.zeros(0, dtype=t), *x]) for t, x in zip((np.int64, np.int64, float), zip(*parts, strict=True) if parts else ((), (), ()), strict=True))
            new = pd.DataFrame({"query": query, "key": batch.column(key).take(pa.array(document)).to_pandas(), "score": value})
            best_rows = new if best_rows is None else pd.concat([best_rows, new], ignore_index=True)
            best_rows = best_rows.sort_values(["query", "score", "key"], ascending=[True, False, True], ignore_index=True).groupby("query", sort=False).head(k)
            last = best_rows.groupby("query")["score"].agg(["size", "min"])
            full = last[last["size"] >= k]
            edge[full.index.to_numpy()] = full["min"].to_numpy()
        if best_rows is not None and len(best_rows):
            yield pa.RecordBatch.from_arrays([pa.array(best_rows["query"].to_numpy()), pa.array(best_rows["key"], type=batch.column(key).type), pa.array(best_rows["score"].to_numpy())], names=["__query", key, "score"])

    found = rows.mapInArrow(run, f"__query long, {key} {kind}, score double")
    names = rows.sparkSession.createDataFrame([(n, i) for n, i in enumerate(asked.ids)], f"__query long, query_id {asked.kind}")
    return best(found.join(F.broadcast(names), "__query").select("query_id", key, "score"), k, key=key)


def matched(docs: DataFrame, key: str, asked: Asked, words: Column) -> DataFrame:
    """key, len (number of words), term, tf (what the document holds of the terms of the queries, as their numbers, and how often) of each document, as a written table: the only pass
    over the texts; all that is further asked of them is asked of numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_at_a_time(batches):
            length, document, term, tf = shared.value.held(batch.column("__w"))
            ends = pa.array(np.searchsorted(document, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(length, pa.int32()), *lists], names=[key, "len", "term", "tf"])

    return written(spread(docs.select(key, words.alias("__w"))).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, len int, term array<int>, tf array<int>"), "matched")


def bm25(docs: DataFrame, queries: DataFrame, key: str, k: int, text: str = "text", k1: float = 1.5, b: float = 0.75, delta: float = 0.5, tokens=text_functions.words, block: int = BROADCAST_ROWS) -> DataFrame:
    """query_id, key, score of the k best documents of each query by BM25L (Lv and Zhai 2011).

    The texts are read once for a block of queries (see matched). What that gives is read twice: for the document frequencies of the terms and the
    mean length (what is shuffled is a row for each term and task), then for the scores of each document in its own row.
    """

    def answer(asked: DataFrame) -> DataFrame:
        own = Asked.of(asked, tokens)
        rows = matched(docs, key, own, tokens(F.col(text)))
        counts = rows.select(F.explode("term").alias("n")).groupBy("n").count().collect()  # a row for each term of the block
        number, total = rows.agg(F.count("*"), F.sum("len")).first()
        df = np.zeros(len(own.terms))
        for r in counts:
            df[r["n"]] = r["count"]
        idf, mean = np.log((number + 1) / (df + 0.5)), max(total or 0, 1) / max(number, 1)

        def score(asked: Asked, batch: pa.RecordBatch) -> Found:
            lists = batch.column("term")
            document = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            term, tf = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            c = tf / (1 - b + b * batch.column("len").to_numpy(zero_copy_only=False)[document] / mean)
            return asked.summed(document, term, idf[term] * (k1 + 1) * (c + delta) / (k1 + c + delta), by_count=True)

        return scored_in_tasks(rows, key, own, k, score)

    return in_blocks(queries, answer, block)


def boolean_phrase(docs: DataFrame, queries: DataFrame, key: str, k: int, text: str = "text", all_words: float = 3.0, phrase: float = 5.0, some_word: float = 1.0, tokens=text_functions.words, block: int = BROADCAST_ROWS) -> DataFrame:
    """query_id, key, score, the k best by the sum of: some_word times the share of the query's words that the document
    has, all_words if it has all, phrase if they follow each other in it. Documents without a word of the query are none."""

    def score(asked: Asked, batch: pa.RecordBatch) -> Found:
        words = batch.column("__w")
        length, document, term, _ = asked.held(words)
        wanted = np.bincount(asked.at, minlength=len(asked.ids))
        ends, numbers = np.cumsum(length), asked.numbers(words).astype(np.int32)
        for own, query, n in asked.summed(document, term, np.ones(len(term)), by_count=False):
            value = some_word * n / wanted[query]
            for i in np.flatnonzero(n >= wanted[query] - 0.5):  # has all words: the phrase is looked for
                d = own[i]
                value[i] += all_words + phrase * _follow(numbers[ends[d] - length[d] : ends[d]].tobytes(), asked.sequences[query[i]].astype(np.int32).tobytes())
            yield own, query, value

    rows = spread(docs.select(key, tokens(F.col(text)).alias("__w")))
    return in_blocks(queries, lambda asked: scored_in_tasks(rows, key, Asked.of(asked, tokens), k, score), block)


def _follow(numbers: bytes, wanted: bytes) -> bool:
    """Whether the wanted 32-bit numbers are in a row somewhere."""
    at = numbers.find(wanted)
    while at >= 0 and at % 4:
        at = numbers.find(wanted, at + 1)
    return at >= 0


# ---- vectors

@dataclass
class Directions:
    """A block of queries by their vectors at length one: what each task needs to score a vector in its own row."""

    ids: list
    kind: str  # their type
    groups: list[dict[int, tuple[np.ndarray, np.ndarray]]]  # of each group of queries, by the length of their vectors (-1: none): their numbers and vectors

    @staticmethod
    def of(asked: pa.Table, kind: str) -> "Directions":
        """asked: query_id, __g (the number of the group), embedding."""
        rows = asked.combine_chunks()
        groups = pc.fill_null(rows.column("__g"), -1).to_numpy()
        lists = pa.concat_arrays(rows.column("embedding").chunks) if rows.num_rows else pa.array([], pa.list_(pa.float64()))
        found: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(int(groups.max(initial=-1)) + 1)]
        for length, at, units in _units(lists):
            for g in np.unique(groups[at]):
                found[g][length] = at[groups[at] == g], units[groups[at] == g]
        return Directions(rows.column("query_id").to_pylist(), kind, found)

    def scored(self, group: np.ndarray, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, queries and the cosines of each row with each query of its group (six digits; -inf: none, inf: not a number), some rows at a time."""
        for length, at, units in _units(lists):
            for g in np.unique(group[at]):
                own = group[at] == g
                rows, vectors = at[own], units[own]
                for other, (queries, wanted) in (self.groups[g] if g < len(self.groups) else {}).items():
                    step = max(1, (1 << 21) // len(queries))
                    for first in range(0, len(rows), step):
                        part = rows[first : first + step]
                        if length != other or length < 0:
                            yield part, queries, np.full((len(part), len(queries)), -np.inf)
                        else:
                            with np.errstate(invalid="ignore"):
                                score = np.round(vectors[first : first + step] @ wanted.T, 6) + 0.0
                            yield part, queries, np.where(np.isnan(score), np.inf, score)


def _units(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, rows and their vectors at length one for each length of vectors (-1: null); zero vectors, and those with a null among their numbers, become zero."""
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        if length < 0:
            yield length, at, np.zeros((len(at), 0))
            continue
        numbers = lists.take(pa.array(at)).flatten()
        holes = numbers.is_null().to_numpy(zero_copy_only=False).reshape(len(at), length).any(axis=1)
        vectors = numbers.fill_null(0).to_numpy(zero_copy_only=False).astype(float).reshape(len(at), length)
        vectors[holes] = 0
        with np.errstate(invalid="ignore", over="ignore"):
            size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            yield length, at, vectors / np.where(size == 0, 1, size)


def cosine_topk(vectors: DataFrame, queries: DataFrame, key: str, k: int, within: list[str] | None = None, block: int = BROADCAST_ROWS) -> DataFrame:
    """query_id, key, score: the k nearest vectors of each query by cosine, exactly.

    The queries (query_id, embedding and the columns of `within`, which must be equal) are the stated set: blocks of
    about `block` of them are sent to all tasks, one after the other, and meet each vector where it is read, as a product of
    matrices. A task hands on its k best of each query: no (query, vector) row is made else.
    """
    dims = within or []
    kind = dict(vectors.dtypes)[key]

    def answer(asked: DataFrame) -> DataFrame:
        spark = asked.sparkSession
        if dims:  # groups of equal columns by number, so that equality is Spark's
            known = asked.select(*dims).where(reduce(Column.__and__, [F.col(d).isNotNull() for d in dims])).distinct()
            groups = spark.createDataFrame([(*r, n) for n, r in enumerate(known.collect())], known.withColumn("__g", F.lit(0)).schema)
            own, rows = asked.join(F.broadcast(groups), dims), vectors.join(F.broadcast(groups), dims)
        else:
            own, rows = asked.withColumn("__g", F.lit(0)), vectors.withColumn("__g", F.lit(0))
        directions = Directions.of(own.select("query_id", "__g", "embedding").toArrow(), dict(asked.dtypes)["query_id"])
        shared = spark.sparkContext.broadcast(directions)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = shared.value
            edge, held, keys = np.full(len(near.ids), -np.inf), None, None
            for batch in batches:
                keys = batch.column(key)
                for row, query, score in near.scored(batch.column("__g").to_numpy(), batch.column("embedding")):
                    least = edge[query]
                    if len(row) > k:
                        least = np.maximum(least, np.partition(score, len(row) - k, axis=0)[len(row) - k])
                    r, q = np.nonzero(score >= least)
                    new = pd.DataFrame({"query": query[q], "key": keys.take(pa.array(row[r])).to_pandas(), "score": score[r, q]})
                    held = new if held is None else pd.concat([held, new], ignore_index=True)
                    held = held.sort_values(["query", "score", "key"], ascending=[True, False, True], na_position="first", ignore_index=True).groupby("query", sort=False).head(k)
                    last = held.groupby("query")["score"].agg(["size", "min"])
                    full = last[last["size"] >= k]
                    edge[full.index.to_numpy()] = full["min"].to_numpy()
            if held is not None and len(held):
                score = held["score"].to_numpy()
                shown = pa.array(np.where(score == np.inf, np.nan, score), pa.float64(), mask=score == -np.inf, from_pandas=False)
                yield pa.RecordBatch.from_arrays([pa.array(held["query"].to_numpy(dtype=np.int64)), pa.array(held["key"], type=keys.type), shown], names=["__query", key, "score"])

        found = rows.select(key, "__g", "embedding").mapInArrow(run, f"__query long, {key} {kind}, score double")
        names = spark.createDataFrame([(n, i) for n, i in enumerate(directions.ids)], f"__query long, query_id {directions.kind}")
        return best(found.join(F.broadcast(names), "__query").select("query_id", key, "score"), k, key=key)

    return in_blocks(queries, answer, block)


# ---- fusion and cuts

def fuse(lexical: DataFrame, vector: DataFrame, key: str, n: int, alpha: float | Column = 0.7, k: float = 60.0, gate: float = 0.35) -> DataFrame:
    """query_id, key, score, similarity, vector_score, bm25_score: weighted reciprocal rank fusion, then the quality gate.

    Ranks count from 0; a side that lacks an id ranks it behind its own and the other side's results and n. The gate
    asks for a squashed lexical score above 0.5 or a vector score of `gate`; a query of which nothing
    passes keeps its best. alpha may be a column of query_id (a struct), to fuse with several weights at once.
    """

    def ranked(rows: DataFrame, score: str, rank: str, number: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))) - 1
        return rows.select("query_id", key, F.col("score").alias(score), place.alias(rank), F.count("*").over(Window.partitionBy("query_id")).alias(number))

    a = ranked(vector, "vector_score", "rank_v", "n_v")
    b = ranked(lexical.withColumn("score", v.squash(F.col("score"))), "bm25_score", "rank_b", "n_b")
    met = a.join(b, ["query_id", key], "full")
    query = Window.partitionBy("query_id")
    behind = F.greatest(F.coalesce(F.max("n_v").over(query), F.lit(0)), F.coalesce(F.max("n_b").over(query), F.lit(0)), F.lit(n))
    met = met.withColumn("__behind", behind)
    score = alpha / (k + F.coalesce("rank_v", "__behind")) + (1 - alpha) / (k + F.coalesce("rank_b", "__behind"))
    similarity = alpha * F.coalesce("vector_score", F.lit(0.0)) + (1 - alpha) * F.coalesce("bm25_score", F.lit(0.0))
    fused = met.select("query_id", key, F.round(score, 9).alias("score"), F.round(similarity, 9).alias("similarity"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.round(F.coalesce("bm25_score", F.lit(0.0)), 6).alias("bm25_score"))
    return passing_or_first(fused, (F.col("bm25_score") > 0.5) | (F.col("vector_score") >= gate), n, F.desc("score"), F.asc(key))


def passing_or_first(rows: DataFrame, passes: Column, n: int, *order: Column, least: int = 1, by: str = "query_id") -> DataFrame:
    """The first n rows of each query that pass; where fewer than `least` pass, its first `least` rows, passing or not."""
    query = Window.partitionBy(by)
    marked = rows.withColumn("__ok", F.coalesce(passes, F.lit(False)))
    marked = marked.withColumn("__passing", F.sum(F.col("__ok").cast("int")).over(query)).withColumn("__all", F.row_number().over(query.orderBy(*order)))
    marked = marked.withColumn("__n", F.row_number().over(query.orderBy(F.desc("__ok"), *order)))
    kept = F.when(F.col("__passing") < least, F.col("__all") <= least).otherwise(F.col("__ok") & (F.col("__n") <= n))
    return marked.where(kept).drop("__ok", "__passing", "__all", "__n")


def relax(tiers: list[DataFrame], least: int = 2) -> DataFrame:
    """Of each query the results of the strictest of three tiers (all filters, some, none) that will do, with tier.

    Fewer than `least` of the first give way to the second if that has more; with none then, to the third.
    """
    first, second, third = tiers
    counted = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").alias(name))
    ids = first.select("query_id").union(second.select("query_id")).union(third.select("query_id")).distinct()
    counts = ids.join(counted(first, "n1"), "query_id", "left").join(counted(second, "n2"), "query_id", "left").fillna(0)
    wider = (F.col("n1") < least) & (F.col("n2") > F.col("n1"))
    chosen = counts.select("query_id", F.when(wider, 2).when(F.col("n1") > 0, 1).otherwise(3).alias("tier"))
    rows = first.withColumn("tier", F.lit(1)).unionByName(second.withColumn("tier", F.lit(2))).unionByName(third.withColumn("tier", F.lit(3)))
    return rows.join(chosen, ["query_id", "tier"])


def boost(rows: DataFrame, first: Column, second: Column, by_first: float = 1.3, by_second: float = 1.15) -> DataFrame:
    """score times 1.3 where the first constraint (department) holds and 1.15 where the second (year) does; similarity
    likewise, 1 at most."""
    factor = F.when(F.coalesce(first, F.lit(False)), by_first).otherwise(1.0) * F.when(F.coalesce(second, F.lit(False)), by_second).otherwise(1.0)
    return rows.withColumn("__f", factor).withColumn("score", F.round(F.col("score") * F.col("__f"), 10)).withColumn("similarity", F.round(F.least(F.lit(1.0), F.col("similarity") * F.col("__f")), 10)).drop("__f")


def union_of_rewrites(results: DataFrame, key: str, n: int) -> DataFrame:
    """Results of several rewrites (column rewrite, from 0) of each query: an id counts once, as the earliest rewrite has it."""
    once = results.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("rewrite"))).where("__n = 1").drop("__n")
    return best(once, n, key=key)


def merge_layers(results: DataFrame, n: int = 5, head: int = 120) -> DataFrame:
    """Results of several collections: rows with one collection, id and content (its first `head` characters) count once, as the
    earliest layer has them; the n best by the larger of similarity and final_score, with place and total_found."""
    once = Window.partitionBy("query_id", "kb_id", "chunk_id", F.substring("content", 1, head)).orderBy("layer")
    kept = results.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    kept = kept.withColumn("merged", F.greatest(F.coalesce("similarity", F.lit(0.0)), F.coalesce("final_score", F.lit(0.0))))
    total = kept.groupBy("query_id").agg(F.count("*").alias("total_found"))
    return top(kept, n, F.desc("merged"), F.asc("kb_id"), F.asc("chunk_id"), rank="place").join(total, "query_id")


def merge_stats(merged: DataFrame, layers: DataFrame) -> DataFrame:
    """query_id, total_results, total_found, avg_similarity, kb_ids (of the merged results, in their order, each once), kb_id (the first), has_result_kb_ids
    (of all results), fallback_used (a layer besides the first has results). merged is merge_layers' result of layers."""
    of = merged.groupBy("query_id").agg(F.count("*").alias("total_results"), F.first("total_found").alias("total_found"), F.avg(F.coalesce("similarity", F.lit(0.0))).alias("avg_similarity"), F.array_sort(F.collect_list(F.struct("place", "kb_id"))).alias("r"))
    found = layers.groupBy("query_id").agg(F.array_sort(F.collect_set("kb_id")).alias("has_result_kb_ids"), (F.max("layer") > 0).alias("fallback_used"))
    kbs = F.array_distinct(F.col("r.kb_id"))
    return of.join(found, "query_id").select("query_id", "total_results", "total_found", F.round("avg_similarity", 8).alias("avg_similarity"), kbs.alias("kb_ids"), F.try_element_at(kbs, F.lit(1)).alias("kb_id"), "has_result_kb_ids", "fallback_used")


def enhanced(questions: DataFrame, paths: list[tuple[DataFrame, Callable[[DataFrame], DataFrame]]], contents: DataFrame, key: str, n: int, rerank: Callable[[DataFrame, DataFrame], DataFrame], coarse: int = 20, weight: float = 0.7) -> DataFrame:
    """query_id, key, place: the whole way of a question. paths: pairs of questions (query_id, text: as they are, rewritten, or a text that
    a model would answer) and a search over them (query_id, key, score). An id counts once, as the earliest path has it; the `coarse` best
    are judged by rerank (results with content, questions: rerank_score, similarity), and diversified by mmr over scaled scores.
    """
    found = reduce(DataFrame.unionByName, [search(asked).select("query_id", key, "score").withColumn("rewrite", F.lit(n_path)) for n_path, (asked, search) in enumerate(paths)])
    pool = union_of_rewrites(found, key, coarse).select("query_id", key, "score")
    judged = rerank(pool.join(contents, key), questions).select("query_id", key, F.col("rerank_score").alias("score"))
    return mmr(judged, contents, key, n, weight, scaled=True)


def route(collections: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
    """query_id, kb_id, score: the pinned collections and the nearest others by cosine, `most` in all (one other at least).

    collections: kb_id, pinned, embedding. Their number is the number of knowledge bases, not of documents.
    """
    met = collections.crossJoin(queries.select("query_id", F.col("embedding").alias("q")))
    scored = met.select("query_id", "kb_id", "pinned", F.round(v.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    pinned = F.sum(F.col("pinned").cast("int")).over(Window.partitionBy("query_id"))
    others = F.row_number().over(Window.partitionBy("query_id", "pinned").orderBy(F.desc("score"), F.asc("kb_id")))
    ranked = scored.withColumn("__pins", pinned).withColumn("__n", others)
    return ranked.where(F.col("pinned") | (F.col("__n") <= F.greatest(F.lit(1), most - F.col("__pins")))).drop("__pins", "__n")


def trigrams(text: Column) -> Column:
    """The distinct character trigrams of each text, as rising numbers."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            c = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            found.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
        return pd.Series(found, dtype=object)

    return run(text)


def mmr(results: DataFrame, contents: DataFrame, key: str, n: int, weight: float = 0.7, content: str = "content", scaled: bool = False) -> DataFrame:
    """query_id, key, place: the n results of each query chosen one by one for the best weight · score - (1 - weight) · the
    largest Jaccard similarity (character trigrams) to one already chosen; the first is the best by score. Ties go to
    the better score, then the smaller id. scaled: scores are scaled to 0 to 1 within a query (all 1 where they are equal).

    results (query_id, key, score) are cut to a pool before: its size bounds a group. contents has each key's text, of which only
    the trigrams of those in the pool are made, once each.
    """
    wanted = contents.join(results.select(key).distinct(), key, "left_semi").select(key, trigrams(F.col(content)).alias("__grams"), F.xxhash64(content).alias("__same"))

    def chosen(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", key], ascending=[False, True], ignore_index=True)
        grams, same, score = pool["__grams"].to_list(), pool["__same"].to_list(), pool["score"].to_numpy(dtype=float)
        if scaled:
            spread = score.max() - score.min()
            score = (score - score.min()) / spread if spread > 0 else np.ones(len(score))

        def alike(a: int, b: int) -> float:
            if not len(grams[a]) or not len(grams[b]):
                return float(same[a] == same[b])
            both = len(np.intersect1d(grams[a], grams[b], assume_unique=True))
            return both / (len(grams[a]) + len(grams[b]) - both)

        left, nearest, order = list(range(1, len(pool))), {}, [0]
        while left and len(order) < n:
            for i in left:
                nearest[i] = max(nearest.get(i, 0.0), alike(i, order[-1]))
            pick = max(left, key=lambda i: (round(weight * score[i] - (1 - weight) * nearest[i], 12), -i))
            order.append(pick)
            left.remove(pick)
        return pd.DataFrame({"query_id": pool["query_id"][order], key: pool[key][order], "place": range(1, len(order) + 1)})

    kinds = dict(results.dtypes)
    return results.select("query_id", key, "score").join(wanted, key).groupBy("query_id").applyInPandas(chosen, f"query_id {kinds['query_id']}, {key} {kinds[key]}, place int")
