"""Approximate nearest neighbours by learned partitions (after Dong et al. 2020).

On a bounded sample of the vectors, the exact neighbour graph is cut into balanced partitions by
recursive spectral bisection. A small classifier (one hidden layer) learns, for each sampled vector, in
which partitions its neighbours lie. It puts every candidate into its most probable partition and routes
each query to the several most probable ones, so many that on sampled queries the wanted share of the
true neighbours is reached; the candidates there are compared exactly. Partitions that are still large
are cut again in the same way, each by a classifier of its own, so that the number of partitions grows with
the table and the share that a query meets falls.

The measure is the inner product, so vectors of different length are first lifted to one length: each
candidate v becomes (v, sqrt(M² - |v|²)), a query (q, 0), which keeps the order of inner products.

Equal vectors are searched once: of each, the k + 1 least ids are candidates (more can't be among the k
nearest, ties going to the smaller id), and equal queries share one search. A partition's candidates and the
queries that meet them are compared in blocks of bounded size, however many fall into it; each candidate
is sent once, but where a partition has more queries than a block holds.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.common import cut


def neighbour_graph(points: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest by inner product of each point of the sample, itself left out."""
    out = np.empty((len(points), min(k, len(points) - 1)), dtype=np.int64)
    for at in range(0, len(points), 512):
        scores = points[at : at + 512] @ points.T
        scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf
        part = np.argpartition(-scores, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[at : at + 512] = np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable"), 1)
    return out


def balanced_partition(graph: np.ndarray, depth: int, seed: int = 3) -> np.ndarray:
    """Cuts a neighbour graph into 2**depth parts of equal size (by one at most): the median of the second
    eigenvector of each part's random walk halves it."""
    n = len(graph)
    own = np.repeat(np.arange(n), graph.shape[1])
    a, b = np.concatenate([own, graph.ravel()]), np.concatenate([graph.ravel(), own])
    part, random = np.zeros(n, dtype=np.int64), np.random.default_rng(seed)
    for _ in range(depth):
        inside = part[a] == part[b]
        x, y = a[inside], b[inside]
        degree = np.maximum(np.bincount(x, minlength=n), 1).astype(float)
        size, weight = np.bincount(part), np.bincount(part, weights=degree)
        value = random.standard_normal(n)
        for _ in range(60):
            value = value - (np.bincount(part, weights=value * degree) / weight)[part]
            value = 0.5 * (value + np.bincount(x, weights=value[y], minlength=n) / degree)
            value /= np.sqrt(np.bincount(part, weights=value * value) / size + 1e-300)[part]
        order = np.lexsort((np.arange(n), value, part))
        rank = np.arange(n) - np.concatenate([[0], np.cumsum(size)])[part[order]]
        part[order] = 2 * part[order] + (rank >= (size[part[order]] + 1) // 2)
    return part


@dataclass
class Router:
    """The classifier: probabilities of the partitions for a vector. Its size is set by its parameters alone."""

    scale: float  # the largest length M
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        scaled = vectors / self.scale
        rest = np.zeros(len(scaled)) if query else np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))
        if query:
            scaled = scaled / np.maximum(np.sqrt((scaled * scaled).sum(1, keepdims=True)), 1e-300)
        return np.concatenate([scaled, rest[:, None]], axis=1)

    def logits(self, lifted: np.ndarray) -> np.ndarray:
        return np.maximum(lifted @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def partitions(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """The most probable partition of candidates, the `probes` most probable of queries."""
        logits = self.logits(self.lifted(vectors, query))
        return np.argsort(-logits, axis=1, kind="stable")[:, : self.probes if query else 1]


def train(router: Router, inputs: np.ndarray, targets: np.ndarray, epochs: int = 30, seed: int = 5) -> None:
    """Adam on the cross entropy with soft targets."""
    random = np.random.default_rng(seed)
    weights = [router.w1, router.b1, router.w2, router.b2]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0002
        order = random.permutation(len(inputs))
        for at in range(0, len(order), 256):
            x, y = inputs[order[at : at + 256]], targets[order[at : at + 256]]
            hidden = np.maximum(x @ router.w1 + router.b1, 0)
            logits = hidden @ router.w2 + router.b2
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - y) / len(x)
            back = (error @ router.w2.T) * (hidden > 0)
            step += 1
            for k, grad in enumerate((x.T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def fit(sample: np.ndarray, scale: float, depth: int, k: int, recall: float, hidden: int = 96, seed: int = 1) -> Router:
    """A router from a sample of distinct vectors. A fifth of it, kept from training, sets the probes."""
    random = np.random.default_rng(seed)
    router = Router(scale, random.standard_normal((sample.shape[1] + 1, hidden)) * np.sqrt(2 / sample.shape[1]), np.zeros(hidden), random.standard_normal((hidden, 2**depth)) * np.sqrt(1 / hidden), np.zeros(2**depth))
    if depth == 0 or len(sample) < 4:
        return router
    candidates = router.lifted(sample, False)
    graph = neighbour_graph(candidates, max(10, min(k, len(sample) // 2**depth)))
    part = balanced_partition(graph, depth)
    share = np.zeros((len(sample), 2**depth))
    np.add.at(share, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph].ravel()), 1.0 / graph.shape[1])
    own = np.eye(2**depth)[part]
    test = random.permutation(len(sample)) < len(sample) // 5
    asked = router.lifted(sample, True)
    train(router, np.concatenate([candidates[~test], asked[~test]]), np.concatenate([(own + share)[~test] / 2, share[~test]]))
    placed = np.argmax(router.logits(candidates), axis=1)
    nearest = nearest_of(asked[test], candidates, np.flatnonzero(test), k)
    rank = np.argsort(np.argsort(-router.logits(asked[test]), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(rank, placed[nearest], 1).ravel()
    router.probes = int(np.searchsorted(np.cumsum(np.bincount(needed, minlength=2**depth)) / len(needed), recall)) + 1
    return router


def nearest_of(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    scores = queries @ candidates.T
    scores[np.arange(len(queries)), own] = -np.inf
    return np.argpartition(-scores, min(k, len(candidates) - 1) - 1, axis=1)[:, : min(k, len(candidates) - 1)]


def usable(vectors: DataFrame, is_query: Column) -> DataFrame:
    """vec_id, v (the vector as it is stored), asked, of the vectors that take part: id and components not null, finite, not all
    zero, of the most frequent dimension (of equally frequent ones the larger). Of rows that share a vec_id that of the least vector counts."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("asked"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)")
    dimension = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).select("d")
    rows = rows.join(F.broadcast(dimension), F.size("v") == F.col("d"), "left_semi")
    return rows.groupBy("vec_id").agg(F.min(F.struct("v", F.coalesce("asked", F.lit(False)).alias("asked"))).alias("x")).select("vec_id", "x.v", "x.asked")


#: Classifiers (some 100 KB each) that are broadcast; beyond that each meets its partition's rows.
BROADCAST = 64


def _depth(rows: int, rows_per_partition: int, least: int) -> int:
    """Of a partition that is cut: 2**depth parts of about rows_per_partition rows, `least` to 64 of them."""
    return int(np.clip(np.ceil(np.log2(max(1, rows / rows_per_partition))), np.ceil(np.log2(least)), 6))


def _level(items: DataFrame, large: DataFrame, level: int, longest: float, k: int, max_sample: int, rows_per_partition: int, least: int, block: int, recall: float) -> DataFrame:
    """items with those of the large nodes (node, n) moved on to the nodes' parts, queries to several each."""
    met = items.join(large, "node")
    sample = met.where(~F.col("asked") & (F.pmod(F.xxhash64(F.lit(level), "v"), F.col("n")) < max_sample)).select("node", "n", "v")

    def learn(part: pd.DataFrame) -> pd.DataFrame:  # of one node: max_sample rows, about
        points = np.stack(part["v"].to_numpy()).astype(float)
        points = points[np.lexsort(points.T)]  # one order, however the rows came
        depth = min(_depth(int(part["n"].iloc[0]), rows_per_partition, least), int(np.log2(max(1, len(points) / 4))))
        return pd.DataFrame({"node": [part["node"].iloc[0]], "n": [part["n"].iloc[0]], "router": [pickle.dumps(fit(points, longest, depth, k, recall))]})

    routers = cut(sample.groupBy("node").applyInPandas(learn, "node long, n long, router binary"))

    def moved_on(own: Router, some: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for asked, part in some.groupby("asked"):
            parts = own.partitions(np.stack(part["v"].to_numpy()).astype(float), bool(asked))
            yield part.loc[part.index.repeat(parts.shape[1])].assign(node=lambda x, p=parts: x["node"] * 64 + p.ravel() + 1)

    if routers.count() <= BROADCAST:
        shared = items.sparkSession.sparkContext.broadcast({r["node"]: r["router"] for r in routers.collect()})

        def move_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = {node: pickle.loads(router) for node, router in shared.value.items()}
            for part in parts:
                for node, some in part.groupby("node"):
                    yield from moved_on(known[node], some) if node in known else [some]

        return items.mapInPandas(move_all, items.schema)
    salts = F.ceil(F.col("n") / block).cast("int")
    dealt = met.withColumn("s", F.pmod(F.xxhash64("a", "b"), salts).cast("int")).select("node", "s", "asked", "a", "b", "v")
    there = routers.select("node", F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"), "router")

    def move(part: pd.DataFrame, router: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="s")
        return pd.concat(moved_on(pickle.loads(router["router"].iloc[0]), part)) if len(part) else part

    moved = dealt.groupBy("node", "s").cogroup(there.groupBy("node", "s")).applyInPandas(move, items.schema)
    return moved.union(items.join(large.select("node"), "node", "left_anti").select(*items.columns))


def search(vectors: DataFrame, is_query: Column, k: int = 20, max_sample: int = 8192, rows_per_partition: int = 1024, least: int = 8, levels: int = 8, block: int = 16384, recall: float = 0.92) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable row for which the column is_query holds, its k nearest
    found among all other usable rows by inner product in double precision, ties to the smaller vec_id.

    The first level has at least `least` partitions (1: no index, so an exact search); a partition of more than four times rows_per_partition rows
    is cut again, up to `levels` times. recall is the share of true neighbours that all levels together are set to keep, judged by the sample. max_sample bounds the sample that each cut is learned from (by a hash of the
    vector; about); every row is indexed. A table without usable rows gives an empty result, and other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors, is_query))
    name = [F.xxhash64("v"), F.xxhash64(F.lit("second"), "v")]  # of a vector: 128 bits of hashes
    same = Window.partitionBy("a", "b").orderBy("vec_id")
    candidates = cut(rows.select("vec_id", "v", name[0].alias("a"), name[1].alias("b")).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1))
    number, longest = candidates.where("n = 1").agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not number:
        return spark.createDataFrame([], schema)
    questions = rows.where("asked").select(name[0].alias("a"), name[1].alias("b"), "v").dropDuplicates(["a", "b"])
    at = F.lit(0).cast("long").alias("node")
    items = cut(candidates.select(at, F.lit(False).alias("asked"), F.col("vec_id").alias("a"), F.lit(0).cast("long").alias("b"), "v").union(questions.select(at, F.lit(True), "a", "b", "v")))
    for level in range(levels if least > 1 and number >= 4 * least else 0):
        sizes = items.where("NOT asked").groupBy("node").agg(F.count("*").alias("n"))
        large = cut(sizes.where(F.col("n") > (4 * rows_per_partition if level else 0)))
        if large.isEmpty():
            break
        items = cut(_level(items, large, level, longest, k, max_sample, rows_per_partition, least, block, 1 - (1 - recall) / 2 ** (level + 1)))  # losses add up to 1 - recall at most
    sizes = cut(items.groupBy("node").agg(F.ceil(F.count_if(~F.col("asked")) / block).cast("int").alias("blocks"), F.ceil(F.count_if("asked") / block).cast("int").alias("sets")).where("blocks > 0 AND sets > 0"))
    met = items.join(sizes, "node")
    deal = lambda n: F.pmod(F.xxhash64("b", "a"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = met.where("NOT asked").select("node", deal("blocks").alias("block"), each("sets").alias("set"), "a", "v")
    right = met.where("asked").select(F.col("node").alias("node"), each("blocks").alias("block"), deal("sets").alias("set"), *[F.col(c).alias(c) for c in ("a", "b", "v")])

    def compare(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        a, b, ids, scores = [], [], [], []
        if len(here) and len(there):
            points, own = np.stack(here["v"].to_numpy()).astype(float), here["a"].to_numpy()
            m = min(k + 1, len(own))
            for at in range(0, len(there), 256):
                part = there.iloc[at : at + 256]
                queries = np.stack(part["v"].to_numpy()).astype(float)
                rough = queries @ points.T
                edge = np.partition(rough, len(own) - m, axis=1)[:, len(own) - m]
                for n, query in enumerate(queries):
                    some = np.flatnonzero(rough[n] >= edge[n] - 1e-9 * max(1.0, abs(edge[n])))
                    exact = (points[some] * query).sum(1)  # the same sum for equal vectors
                    best = np.lexsort((own[some], -exact))[:m]
                    ids.append(own[some][best])
                    scores.append(-exact[best])
                a.append(part["a"])
                b.append(part["b"])
        return pd.DataFrame({"a": pd.concat(a) if a else [], "b": pd.concat(b) if b else [], "far": scores, "ids": ids})

    found = left.groupBy("node", "block", "set").cogroup(right.groupBy("node", "block", "set")).applyInPandas(compare, "a long, b long, far array<double>, ids array<long>")
    # Of each query vector the k + 1 best of all its partitions; each query then leaves itself out.
    best = found.groupBy("a", "b").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("far", "ids")))), 1, k + 1).alias("best"))
    who = rows.where("asked").select(F.col("vec_id").alias("query_id"), name[0].alias("a"), name[1].alias("b"))
    others = F.slice(F.filter("best", lambda x: x["ids"] != F.col("query_id")), 1, k)
    out = who.join(best, ["a", "b"]).select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), (0.0 - F.col("x.far")).alias("score"))
