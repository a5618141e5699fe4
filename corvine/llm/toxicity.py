"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Learning. Labelled examples are a bounded sample of the labelled rows it may learn from (max_examples,
max_words). Examples of one label with the same set of words count once. The vectors hold all words of
the examples' vocabulary: TF-IDF, with document frequencies from all documents, times one more factor for
words that are surely more frequent in toxic examples than in others (1 + their evidence in nats, where it is beyond
what the best of all tested words reaches by chance), so that a few such words tell in a long text, too.

Searching. Examples are ordered by their strongest frequent word and cut into blocks. Posting lists of rare
words are short and read whole. For a frequent word the index holds its largest weight in each block: the products
of a text's weights with these, and what the rare words give the best example of the block, bound the
cosines in it. The blocks with the largest bounds are scored first; then only those whose bound is
above the k-th cosine that is surely reached. The result is the exact k nearest examples.

Their votes, weighted by similarity and joined by some of the base rate, are made a probability by isotonic
regression over the votes for the examples themselves, each left out of its own search.
"""

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import cut, fresh

_WORD = re.compile(r"\w+")
SLACK = 1e-9  # of cosines: sums in another order


def words(text: str | None) -> Counter:
    """Words of the whole text with their counts."""
    return Counter(_WORD.findall((text or "").lower()))


def hash_word(word: str) -> int:
    """A stable 64-bit hash of a word or words."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


@dataclass
class Model:
    """Bounded by max_examples and max_words: it is broadcast to the executors."""

    terms: dict[str, int]
    weight_of: np.ndarray  # of each term: its inverse document frequency times its factor
    starts: np.ndarray  # example e has the terms cols[starts[e]:starts[e + 1]], rising, ...
    cols: np.ndarray
    weights: np.ndarray  # ... with these weights, of length one together
    toxic: np.ndarray
    ids: np.ndarray  # doc_ids of the examples
    k: int = 25
    prior: float = 1.0
    block: int = 64
    rare: int = 256  # examples that hold a rare term at most
    curve: tuple[np.ndarray, np.ndarray] | None = None  # votes and the probabilities they stand for

    def __getstate__(self) -> dict:
        return {n: v for n, v in self.__dict__.items() if n not in ("index", "names", "sent", "curve")}  # made anew where it is needed; the curve is sent by itself

    def shared(self, context: SparkContext) -> Broadcast:
        """The broadcast model without its curve: sent once, for learning the curve and for scoring."""
        sent = self.__dict__.get("sent")
        if sent is None or sent[0] is not context:
            sent = self.__dict__["sent"] = (context, context.broadcast(self))
        return sent[1]

    @property
    def base(self) -> float:
        return float((self.toxic.sum() + 0.5) / (len(self.toxic) + 1))

    @cached_property
    def index(self) -> dict:
        n, lengths = len(self.ids), np.diff(self.starts)
        held = np.bincount(self.cols, minlength=len(self.terms))
        frequent = np.flatnonzero(held > self.rare)
        place = np.full(len(self.terms), -1)
        place[frequent] = np.arange(len(frequent))
        entry, at = np.repeat(np.arange(n), lengths), place[self.cols]
        strong = np.lexsort((-self.weights, entry, at < 0))
        strongest = np.full(n, -1)
        strongest[entry[strong][::-1]] = at[strong][::-1]
        order = np.lexsort((self.ids, strongest))
        number = np.empty(n, dtype=np.int64)
        number[order] = np.arange(n)
        blocks = max(1, -(-n // self.block))
        dense = np.zeros((len(frequent), blocks * self.block))
        dense[at[at >= 0], number[entry[at >= 0]]] = self.weights[at >= 0]
        rows, numbers, values = self.cols[at < 0], number[entry[at < 0]], self.weights[at < 0]
        by_term = np.lexsort((numbers, rows))
        return {
            "order": order, "place": place, "dense": dense, "blocks": blocks, "bounds": dense.reshape(len(frequent), blocks, self.block).max(2),
            "lists": np.searchsorted(rows[by_term], np.arange(len(self.terms) + 1)), "numbers": numbers[by_term], "values": values[by_term],
        }

    def vectors(self, found: list[Counter]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts the terms, their weights (of length one together in a text), and where each text's begin. Words that no
        example has are left out: they change all cosines of the text in one proportion."""
        get, parts = self.terms.get, []
        for own in found:
            at = np.fromiter(map(get, own, repeat(-1)), dtype=np.int64, count=len(own))
            n = np.fromiter(own.values(), dtype=np.int64, count=len(own))
            parts.append((at[at >= 0], n[at >= 0]))
        starts = np.concatenate([[0], np.cumsum([len(at) for at, _ in parts])]).astype(np.int64)
        at, n = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*parts, strict=True))
        weight = (1 + np.log(n)) * self.weight_of[at]
        text = np.repeat(np.arange(len(parts)), np.diff(starts))
        return at, weight / np.sqrt(np.bincount(text, weight * weight, minlength=len(parts)))[text], starts

    def nearest(self, at: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text (vectors as `vectors` gives them) the exact k examples of largest positive cosine (ties to the smaller doc_id), and these."""
        k, ix, number = k or self.k, self.index, len(starts) - 1
        blocks, size = ix["blocks"], self.block
        text, place = np.repeat(np.arange(number), np.diff(starts)), ix["place"][at]
        asked = np.zeros((number, len(ix["dense"])))
        asked[text[place >= 0], place[place >= 0]] = weight[place >= 0]
        few, w = at[place < 0], weight[place < 0]
        first = ix["lists"][few]
        lengths = ix["lists"][few + 1] - first
        reads = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        where = np.repeat(text[place < 0] * (blocks * size), lengths) + ix["numbers"][reads]
        sums = np.bincount(where, np.repeat(w, lengths) * ix["values"][reads], minlength=number * blocks * size).astype(float).reshape(number, blocks, size)
        bound = asked @ ix["bounds"] + sums.max(2)
        seeds = min(blocks, -(-k // size) + 1)
        wanted = np.zeros((number, blocks), dtype=bool)
        np.put_along_axis(wanted, np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds], True, axis=1)
        self._score(sums, asked, wanted)
        seen = sums[wanted].reshape(number, seeds * size)
        reached = np.partition(seen, -k, axis=1)[:, -k] if k <= seeds * size else np.zeros(number)
        more = ~wanted & (bound > np.maximum(reached[:, None] - SLACK, 0.0))
        self._score(sums, asked, more)
        out, wanted = [], wanted | more
        for row, some in zip(sums, wanted, strict=True):
            own = np.flatnonzero(some)
            row = np.round(row[own].ravel(), 10)
            best = np.flatnonzero(row >= max(np.partition(row, -k)[-k] if len(row) > k else 0.0, 1e-10))
            e = ix["order"][own[best // size] * size + best % size]
            first = np.lexsort((self.ids[e], -row[best]))[:k]
            out.append((e[first], row[best][first]))
        return out

    def _score(self, sums: np.ndarray, asked: np.ndarray, wanted: np.ndarray) -> None:
        """Adds what the frequent terms give to the examples of the wanted blocks."""
        for b in np.flatnonzero(wanted.any(0)):
            who = np.flatnonzero(wanted[:, b])
            sums[who, b] += asked[who] @ self.index["dense"][:, b * self.block : (b + 1) * self.block]

    def votes(self, near: np.ndarray, sims: np.ndarray) -> float:
        return float((sims @ self.toxic[near] + self.prior * self.base) / (sims.sum() + self.prior))

    def probability(self, votes: np.ndarray) -> np.ndarray:
        return votes if self.curve is None else np.interp(votes, *self.curve)

    def evidence(self, at: np.ndarray, weight: np.ndarray, e: int, most: int = 5) -> list[str]:
        """The text's words that add most to the cosine of this example."""
        cols, values = self.cols[self.starts[e] : self.starts[e + 1]], self.weights[self.starts[e] : self.starts[e + 1]]
        there = np.minimum(np.searchsorted(cols, at), len(cols) - 1)
        share = np.where(cols[there] == at, values[there] * weight, 0.0)
        best = np.flatnonzero(share >= max(np.partition(share, -most)[-most] if len(share) > most else 0.0, 1e-10))
        return [self.names[at[i]] for i in best[np.lexsort((at[best], -np.round(share[best], 10)))][:most]]

    def scores(self, texts: list[str | None], batch: int = 64) -> list[tuple[float, list[int], list[str]]]:
        """Score, doc_ids of the nearest examples and the words that led to the nearest, of each text."""
        out = []
        for first in range(0, len(texts), batch):
            found = [words(t) for t in texts[first : first + batch]]
            at, weight, starts = self.vectors(found)
            near = self.nearest(at, weight, starts) if len(self.ids) else [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(found)
            chances = self.probability(np.array([self.votes(*f) for f in near]))
            for chance, (e, _), a, b in zip(chances.tolist(), near, starts, starts[1:], strict=False):
                out.append((chance, self.ids[e[:3]].tolist(), self.evidence(at[a:b], weight[a:b], e[0]) if len(e) else []))
        return out

    @cached_property
    def names(self) -> list[str]:
        return list(self.terms)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0


def factors(cols: np.ndarray, entry: np.ndarray, toxic: np.ndarray, terms: int, sure: float = 4.0) -> np.ndarray:
    """1 + evidence of each term for toxic, n KL(its toxic share | rate) in nats, where it is beyond ln(tested terms) + sure;
    1 elsewhere. Terms of three toxic examples and more are tested."""
    held, bad = np.bincount(cols, minlength=terms), np.bincount(cols, toxic[entry], minlength=terms)
    rate = toxic.mean() if len(toxic) else 0.0
    if not 0 < rate < 1:
        return np.ones(terms)
    part = lambda n, of: np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(of, 1e-300)), 0.0)
    tested = (bad > held * rate) & (bad >= 3)
    evidence = np.where(tested, part(bad, held * rate) + part(held - bad, held * (1 - rate)), 0.0)
    return 1 + np.where(evidence > np.log(max(tested.sum(), 1)) + sure, evidence, 0.0)


def isotonic(votes: np.ndarray, toxic: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of probability over votes (pool adjacent violators), each with half a vote of the base rate."""
    order = np.argsort(votes, kind="stable")
    steps: list[list[float]] = []  # votes, toxic, number
    for v, y in zip(votes[order].tolist(), toxic[order].tolist(), strict=True):
        steps.append([v, y, 1.0])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            v, y, n = steps.pop()
            steps[-1] = [steps[-1][0] + v, steps[-1][1] + y, steps[-1][2] + n]
    v, y, n = np.array(steps).T
    return v / n, np.maximum.accumulate((y + base / 2) / (n + 0.5))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 4096, max_words: int = 4_000_000) -> Model:
    """Learns from rows of labels whose crc32(doc_id) mod 5 is not 0 and whose toxic is 0 or 1.

    max_examples bounds the sample of labelled rows, max_words the distinct words of its texts together (both
    about; chosen by a hash of doc_id, the same at every run). Document frequencies are of all documents.
    """
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    # Rows of one doc_id with both labels count as toxic.
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    number = max(1, usable.count())
    sample = usable.where(F.pmod(F.xxhash64("__id"), F.lit(number)) < max_examples)
    examples = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id").cast("long") == F.col("__id"))

    def counted(batches):
        for batch in batches:
            found = [words(t) for t in batch.column("text").to_pylist()]
            # Copies share their word set; words hold no blank.
            sets = [hash_word(" ".join(sorted(f))) - 2**63 for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__toxic"), pa.array(sets, pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "word", "n"])

    rows = cut(examples.select("__id", "__toxic", "text").mapInArrow(counted, "doc_id long, toxic int, words long, word array<string>, n array<int>"))
    firsts = rows.groupBy("words", "toxic").agg(F.min("doc_id").alias("doc_id"))
    once = rows.join(firsts, ["words", "toxic", "doc_id"]).dropDuplicates(["doc_id"])
    held = rows.agg(F.sum(F.size("word"))).first()[0] or 0
    if held > max_words:
        once = once.where(F.pmod(F.xxhash64(F.lit("words"), "doc_id"), F.lit(held)) < max_words)
    # The sample comes to the driver as columns: this many words at most.
    local = once.select("doc_id", "toxic", "word", "n").toArrow().sort_by("doc_id")
    lists = local.column("word").combine_chunks() if local.num_rows else pa.array([], pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    dictionary = coded.dictionary
    term, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), local.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False) if local.num_rows else np.zeros(0, dtype=np.int32)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if local.num_rows else np.zeros(0, dtype=np.int64)
    entry, toxic, ids = np.repeat(np.arange(len(lengths)), lengths), local.column("toxic").to_numpy().astype(np.int64), local.column("doc_id").to_numpy().astype(np.int64)
    n = np.array(n)  # a copy: the columns are not needed any more, and Arrow keeps their memory else
    del local, lists, coded
    pa.default_memory_pool().release_unused()

    known = docs.sparkSession.sparkContext.broadcast(frozenset(dictionary.to_pylist()))

    def holding(batches):  # partial counts of each task
        total, number = Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                number += 1
                total.update(known.value.intersection(_WORD.findall((text or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array([*total, ""], pa.string()), pa.array([*total.values(), number], pa.int64())], names=["word", "n"])

    df = docs.select("text").mapInArrow(holding, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    known.destroy()  # the driver's copy as well
    # The counts stay columns: one Python object for each word and count would be several times as large.
    number, place = df.column("n").to_numpy(), pc.index_in(df.column("word").cast(dictionary.type), value_set=dictionary)
    own = place.is_valid().to_numpy()
    often = np.zeros(len(dictionary), dtype=np.int64)
    often[place.drop_null().to_numpy()] = number[own]
    idf = np.log((number[~own].sum() + 1) / (often + 1)) + 0.1  # what is no term is the empty word, which stands for all documents
    del df, place, own, number, often
    weight_of = idf * factors(term, entry, toxic, len(dictionary))
    weight = (1 + np.log(n)) * weight_of[term]
    order = np.lexsort((term, entry))
    weight = weight / np.sqrt(np.bincount(entry, weight * weight, minlength=len(lengths)))[entry]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    term, weight = term[order], weight[order]
    del order, entry, n
    model = Model({w: t for t, w in enumerate(dictionary.to_pylist())}, weight_of, starts, term, weight, toxic, ids)
    del dictionary
    pa.default_memory_pool().release_unused()
    if not 0 < toxic.sum() < len(toxic):
        return model
    shared = model.shared(docs.sparkSession.sparkContext)

    def left_out(parts):  # the examples' votes without themselves
        own = shared.value
        for part in parts:
            e = part["id"].to_numpy()
            reads = np.concatenate([np.arange(own.starts[n], own.starts[n + 1]) for n in e])
            found = own.nearest(own.cols[reads], own.weights[reads], np.concatenate([[0], np.cumsum(np.diff(own.starts)[e])]), own.k + 1)
            yield pd.DataFrame({"id": e, "votes": [own.votes(near[near != n][: own.k], sims[near != n][: own.k]) for n, (near, sims) in zip(e, found, strict=True)]})

    tasks = max(1, len(toxic) // 128)
    own = docs.sparkSession.range(0, len(toxic), 1, tasks).mapInPandas(left_out, "id long, votes double").toPandas().sort_values("id")
    model.curve = isotonic(own["votes"].to_numpy(), toxic, model.base)
    return model


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """docs with a struct column added (replacing one of its name): score, nearest (doc_ids of up to three examples) and evidence
    (words of the text that led there). Null and empty texts have no neighbours; the base rate scores them."""
    shared, curve = model.shared(docs.sparkSession.sparkContext), model.curve

    @F.pandas_udf("score double, nearest array<long>, evidence array<string>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        shared.value.curve = curve
        return pd.DataFrame(shared.value.scores(texts.tolist()), columns=["score", "nearest", "evidence"])

    return docs.withColumn(column, scored("text"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, nearest, evidence of each row of docs.

    Repeated rows are scored each; a null doc_id is not held out and no example. Without labelled rows
    every score is 0.5. Other columns of both tables are ignored.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), "toxicity.nearest", "toxicity.evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not predicted toxic; columns stay as they are. Without labelled rows nothing is known to be toxic, and all stay."""
    own, model = fresh(docs, "toxicity"), fit(docs, labels, **options)
    if not len(model.toxic):
        return docs
    return score(docs, model, own).where(F.col(own)["score"] < 0.5).select(*docs.columns)
