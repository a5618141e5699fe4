"""Language identification in two steps: the language family, then the language within it.

Texts are counted character n-grams (one to three letters, blanks for what is no letter) hashed into a
fixed number of places, square roots of their shares. Families are told apart, and then the closely
related languages of one family, by one-versus-one linear support vector machines, trained on
a bounded sample of the documents that may be learned from: each pair of names is one task.
"""

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.common import cut

#: Language codes by family; a code that is in none is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo fy lb af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn pa gu mr ne ur si",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "austronesian": "id ms tl jv",
}
PLACES = 8192
_SLICE = 1 << 20


def family_of(lang: Column) -> Column:
    known = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.lower(F.split(lang, "[-_]")[0])], F.concat(F.lit("only "), lang))


_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters[codes]


def features(text: str | None) -> np.ndarray | None:
    """The vector of a whole text (of length one); None if it has no letter. Long texts are counted in slices."""
    counts, some = np.zeros(PLACES), False
    lowered = (text or "").lower()
    for at in range(0, len(lowered), _SLICE):
        codes = np.frombuffer(lowered[max(0, at - 2) : at + _SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _is_letter(codes)
        if not letter.any():
            continue
        some = True
        keep = letter | np.concatenate([[True], letter[:-1]])  # of a run of others, one stays as a blank
        c = np.where(letter, codes, 32)[keep].astype(np.uint64)
        c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
        one, two = c * np.uint64(0x9E3779B97F4A7C15), (c[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        three = two[:-1] * np.uint64(0x165667B19E3779F9) ^ (c[2:] * np.uint64(0x27D4EB2F165667C5))
        for grams in (one, two, three):
            counts += np.bincount((grams * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(51)).astype(np.int64), minlength=PLACES)
    return np.sqrt(counts / counts.sum()) if some else None


@dataclass
class Machines:
    """One-versus-one machines for a set of names: weights[k] and bias[k] are positive for pairs[k][0]."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def chances(self, vector: np.ndarray, sharpness: float = 3.0) -> np.ndarray:
        """Chances of the names: mean of the pairs' chances, scaled to a sum of one."""
        if len(self.names) == 1:
            return np.ones(1)
        wins = np.zeros(len(self.names))
        for (a, b), margin in zip(self.pairs, self.weights @ vector + self.bias, strict=True):
            chance = 1 / (1 + np.exp(-sharpness * margin))
            wins[a] += chance
            wins[b] += 1 - chance
        return wins / wins.sum()


@dataclass
class Model:
    """PLACES numbers for each pair of families and each pair of languages in a family."""

    families: Machines
    languages: dict[str, Machines]

    def predict(self, text: str | None) -> tuple[str, float]:
        vector = features(text)
        if vector is None or not self.families.names:
            return "und", 0.0
        of_family = self.families.chances(vector)
        f = int(np.argmax(of_family))
        own = self.languages[self.families.names[f]]
        within = own.chances(vector)
        best = int(np.argmax(within))
        return own.names[best], float(min(1.0, of_family[f] * within[best]))


def machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, places: int = PLACES, c: float = 100.0, epochs: int = 60, enough: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of the linear support vector machine with squared hinge loss over rows (places, values): the minimum
    of w·w / 2 + c / n sum max(0, 1 - y w·x)², for y of -1 and 1, by dual coordinate descent (Hsieh et al. 2008)."""
    rows = [(np.append(at, places), np.append(value, 1.0).astype(float)) for at, value in rows]
    w, alpha, random, soft = np.zeros(places + 1), np.zeros(len(rows)), np.random.default_rng(seed), len(rows) / (2 * c)
    square = [float(value @ value) + soft for _, value in rows]
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(rows)).tolist():
            at, value = rows[i]
            grad = y[i] * (w[at] @ value) - 1 + soft * alpha[i]
            if alpha[i] > 0 or grad < 0:
                new = max(0.0, alpha[i] - grad / square[i])
                worst = max(worst, abs(new - alpha[i]) * square[i])
                w[at] += (new - alpha[i]) * y[i] * value
                alpha[i] = new
        if worst < enough:
            break
    return w


def _machines(rows: DataFrame, groups: dict[str, list[str]]) -> dict[str, Machines]:
    """Of each group its machines, from rows of kind (the group), name, at, value. Each pair is learned in a task of its own, from
    the rows of its two names."""
    pairs = [(g, a, b) for g, names in groups.items() for a, b in combinations(range(len(names)), 2)]
    found: dict[tuple, np.ndarray] = {}
    if pairs:
        sides = [(g, groups[g][n], k, y) for k, (g, a, b) in enumerate(pairs) for n, y in ((a, 1), (b, -1))]
        met = rows.join(F.broadcast(rows.sparkSession.createDataFrame(sides, "kind string, name string, pair int, y int")), ["kind", "name"])

        def learn(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["y", "doc_id", "text_hash"])  # one order, however the rows came
            return pd.DataFrame({"pair": [part["pair"].iloc[0]], "w": [machine(list(zip(part["at"], part["value"], strict=True)), part["y"].to_numpy())]})

        found = {r["pair"]: np.array(r["w"]) for r in met.repartition(len(pairs), "pair").groupBy("pair").applyInPandas(learn, "pair int, w array<double>").collect()}
    out = {}
    for g, names in groups.items():
        own = [(k, (a, b)) for k, (h, a, b) in enumerate(pairs) if h == g]
        weights = np.array([found[k] for k, _ in own]).reshape(len(own), PLACES + 1)
        out[g] = Machines(names, [p for _, p in own], weights[:, :-1], weights[:, -1])
    return out


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_language: int = 1000) -> Model:
    """Learns from rows with a lang whose crc32(doc_id) mod 4 is not 2. per_language bounds the sample of each
    language (about; chosen by a hash of doc_id, the same at every run). Rows without a letter teach nothing."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    numbers = usable.groupBy("lang").agg(F.count("*").alias("__n"))
    sample = usable.join(F.broadcast(numbers), "lang").where(F.pmod(F.xxhash64("doc_id"), F.col("__n")) < per_language)

    def vectors(batches):
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            keep = [i for i, f in enumerate(found) if f is not None]
            at = [np.flatnonzero(found[i]) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("family", "lang", "doc_id", "text_hash")), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([found[i][a].astype(np.float32) for i, a in zip(keep, at, strict=True)], pa.list_(pa.float32()))],
                names=["family", "lang", "doc_id", "text_hash", "at", "value"],
            )

    sample = sample.select(family_of(F.col("lang")).alias("family"), "lang", "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = cut(sample.mapInArrow(vectors, "family string, lang string, doc_id long, text_hash long, at array<int>, value array<float>"))
    known = sorted((r["family"], r["lang"]) for r in rows.select("family", "lang").distinct().collect())
    families = sorted({f for f, _ in known})
    # A family's languages share its part of the sample.
    shared = F.lit(per_language) / F.create_map(*[F.lit(x) for f in families for x in (f, sum(g == f for g, _ in known))])[F.col("family")] if families else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text_hash")))
    of_family = rows.withColumn("rank", rank).where(F.col("rank") <= shared).select(F.lit("families").alias("kind"), F.col("family").alias("name"), "doc_id", "text_hash", "at", "value")
    of_language = rows.select("family", F.col("lang").alias("name"), "doc_id", "text_hash", "at", "value").withColumnRenamed("family", "kind")
    top = _machines(of_family, {"families": families})["families"]
    return Model(top, _machines(of_language, {f: [n for g, n in known if g == f] for f in families}))


def identify(docs: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """docs with a struct column added (replacing one of its name): lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(column, language("text"))


def languages(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs.

    Null texts and texts without a letter are `und` with score 0, as is every text when nothing can be
    learned; a single learned language is every text's. Repeated rows are predicted each; a null doc_id
    is not held out and teaches nothing. An empty table gives an empty result.
    """
    named = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, per_language))
    return named.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")
