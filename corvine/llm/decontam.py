"""Benchmark decontamination: passages of documents within a small edit distance of benchmark items.

Texts are sequences of words (letters and digits, lower case). The CGK random-walk embedding (Chakraborty,
Goldenberg, Koucky 2016) writes a word at each step and moves on to the next word or stays, by a random
function of step and word; after the walk, a small edit distance is a small Hamming distance. Bit-sampling
LSH on top: a repetition draws a walk and a few of its steps; the words written there are a key. Items are
taken in classes of length. The walks of a class see windows as long as its shortest item; they start at
each word of a document, and in an item so often, one after the other up to its end, that they see all of it:
equal keys make a candidate of the item's size there. Repetitions start at different words of the window and
alternate between forward and backward. There are as many as reach the target recall on
random items with all the edits that the limit allows, anywhere or in one third of the item (counted).

Pieces measure what the walks miss (tests; they take no part in a search): an item of m words that may
differ in k is cut into k + 1 pieces, of which k edits leave one as it is (pigeonhole), so a text within the limit holds one.
Each candidate is verified by the exact edit distance of the item to the best part of
the text around it (Myers' bit-vectors).

Keys are compared step by step: a window whose words differ from all items' at one sampled step can't
have an item's key and isn't walked further, which changes no key and drops no candidate.

The benchmark is the stated query set: it is taken in blocks of bounded size, each broadcast, run against all
documents and let go; documents are never shuffled or collected.
"""

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import cut

_WORD = re.compile(r"[^\W_]+")
_FACTOR, _LOW = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Items by length in words; the last class is open.
CLASSES = ((1, 1), (2, 3), (4, 7), (8, 14), (15, None))
LEAKS = "array<struct<item_id: long, distance: int, n_words: int, start: int, end: int>>"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class _Walk:
    """A repetition: the word of a window that it starts at, the steps that are sampled, moves[step, word], and the items' keys."""

    back: bool
    start: int
    steps: list[int]
    moves: np.ndarray
    prefixes: list[np.ndarray] = field(default_factory=list)
    items: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by key: items, and the word that the walk starts at

    @staticmethod
    def drawn(random: np.random.Generator, least: int, samples: int, words: int, back: bool) -> "_Walk":
        """A walk from a word of the first three quarters of a window of `least` words on, of two steps a word, over words up to this number
        and one that pads. Its first step is always sampled: most places of a text are left behind there."""
        start = int(random.integers(0, 3 * least // 4)) if least > 1 else 0
        length = 2 * (least - start)
        steps = [0, *sorted(1 + random.choice(length - 1, size=min(samples, length) - 1, replace=False))]
        return _Walk(back, start, [int(x) for x in steps], random.integers(0, 2, (length, words + 2), dtype=np.int32))

    def keys(self, at: np.ndarray, text: np.ndarray, keep: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows at the positions `at` of the padded text those that may have an item's key, and their keys."""
        key, here, k = np.zeros(len(at), dtype=np.uint64), at.copy(), 0
        for step in range(self.steps[-1] + 1):
            word = text[here]
            if step == self.steps[k]:
                key = (key * np.uint64(_FACTOR)) ^ (word.astype(np.uint64) + np.uint64(1))
                if keep is not None:
                    known = keep[k]
                    if k == 0:
                        good = known[word]
                    else:
                        good = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                    at, here, key, word = at[good], here[good], key[good], word[good]
                k += 1
            here += self.moves[step].take(word)
        return at, key


def _starts(walk: _Walk, least: int, m: int) -> list[int]:
    """Where walks start in an item of m words; the last ends with it."""
    return sorted({walk.start + n for n in (*range(0, m - least + 1, least), m - least)})


@lru_cache
def repetitions(least: int, most: int, ratio: float, recall: float, samples: int, tries: int = 400, limit: int = 64) -> int:
    """How many walks find this share of items of `least` to `most` words in which all words that may be are changed, lost or
    added: counted on random items of the hardest lengths. An error if that takes more than `limit`."""
    needed, size = 1, 2000
    for m in [m for m in range(least, most + 1) if m == least or int(ratio * m) > int(ratio * (m - 1))]:
        random, n_edits, room = np.random.default_rng(5), int(ratio * m), 3 * most + 4 * least
        pad = lambda n: random.integers(1, size, n).tolist()  # noqa: B023, E731
        items, texts = [], []
        for n in range(tries):
            item = pad(m)
            edited = list(item)
            low, high = (0, m) if n % 2 else (n // 2 % 3 * m // 3, (n // 2 % 3 + 1) * m // 3)  # anywhere, or in one third
            for kind in random.integers(0, 3, n_edits).tolist():  # another word, none, one more
                p = min(len(edited), int(random.integers(low, max(low + 1, high))))
                edited[p : p + (kind != 2)] = pad(int(kind != 1))
            items.append(item + [size] * (room - m))
            texts.append((pad(least) + edited + pad(room))[:room])
        found, joined, other = np.zeros(tries, dtype=bool), np.concatenate(items), np.concatenate(texts)
        begins = np.arange(tries) * room
        for n in range(limit):
            walk = _Walk.drawn(random, least, samples, size, False)
            for start in _starts(walk, least, m):
                _, wanted = walk.keys(begins + start, joined, None)
                for shift in range(-n_edits, n_edits + 1):
                    _, got = walk.keys(begins + least + start + shift, other, None)
                    found |= got == wanted
            if found.mean() >= recall:
                break
        else:
            raise ValueError(f"{limit} walks of {samples} samples don't reach a recall of {recall} for items of {m} words")
        needed = max(needed, n + 1)
    return needed


@dataclass
class _Pieces:
    """The pieces of a block of items by their hash: prefixes[n] are the sorted hashes of the first n + 1 words of all pieces of
    more than n words, items[n] the (item, first word of the piece) of pieces of n + 1 words."""

    prefixes: list[np.ndarray]
    items: list[dict[int, list[tuple[int, int]]]]

    @staticmethod
    def build(rows: list[list[int]], ratio: float) -> "_Pieces":
        known: list[set[int]] = []
        items: list[dict[int, list[tuple[int, int]]]] = []
        for n, tokens in enumerate(rows):
            m, parts = len(tokens), int(ratio * len(tokens)) + 1
            for i in range(parts):
                key, first, last = 0, i * m // parts, (i + 1) * m // parts
                for k, word in enumerate(tokens[first:last]):
                    key = (key * _FACTOR & _LOW) ^ (word + 1)
                    if k == len(known):
                        known.append(set())
                        items.append({})
                    known[k].add(key)
                if last > first:  # a ratio of one and more allows more edits than words
                    items[last - first - 1].setdefault(key, []).append((n, first))
        return _Pieces([np.array(sorted(k), dtype=np.uint64) for k in known], items)

    def met(self, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]]:
        """For each length of pieces the places among `at` of the padded text where one may begin, their hashes, and its items."""
        key = np.zeros(len(at), dtype=np.uint64)
        for n, (known, items) in enumerate(zip(self.prefixes, self.items, strict=True)):
            key = (key * np.uint64(_FACTOR)) ^ (text[at + n].astype(np.uint64) + np.uint64(1))
            good = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            at, key = at[good], key[good]
            if items:
                yield at, key, items
            at, key = at[at + n + 1 < len(text)], key[at + n + 1 < len(text)]


@dataclass
class Index:
    """LSH tables and pieces of a block of benchmark items. Words that no item has are word 0: they equal none."""

    vocabulary: dict[str, int]
    item_ids: list[int]
    lengths: list[int]
    masks: list[dict[int, int]]
    classes: list[list[_Walk]]
    ratio: float
    pieces: _Pieces

    @staticmethod
    def build(items: list[tuple[int, str | None]], ratio: float = 0.2, recall: float = 0.95, samples: int = 3, seed: int = 7, whole: bool = False) -> "Index":
        """recall: what the walks reach for passages with all the edits that the limit allows. whole: with pieces beside them, which miss nothing; the tests measure the
        walks against them."""
        vocabulary: dict[str, int] = {}
        rows = [(i, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)]) for i, t in items if i is not None]
        rows = [r for r in rows if r[1]]
        masks = []
        for _, tokens in rows:
            own: dict[int, int] = {}
            for p, t in enumerate(tokens):
                own[t] = own.get(t, 0) | 1 << p
            masks.append(own)
        index = Index(vocabulary, [i for i, _ in rows], [len(t) for _, t in rows], masks, [], ratio, _Pieces.build([t for _, t in rows] if whole else [], ratio))
        random = np.random.default_rng(seed)
        for least, most in CLASSES:
            own = [n for n, (_, t) in enumerate(rows) if least <= len(t) <= (most or len(t))]
            if not own:
                continue
            walks = []
            for r in range(repetitions(least, most or 2 * least - 1, ratio, recall, samples)):
                walk = _Walk.drawn(random, least, samples, len(vocabulary), bool(r % 2))
                tokens = [rows[n][1][::-1] if walk.back else rows[n][1] for n in own]
                # The last walk in an item ends with it.
                starts = [_starts(walk, least, len(t)) for t in tokens]
                gap = np.full(2 * least + 1, len(vocabulary) + 1, dtype=np.int32)
                joined = np.concatenate([part for t in tokens for part in (np.array(t, dtype=np.int32), gap)])
                begins = np.cumsum([0] + [len(t) + len(gap) for t in tokens[:-1]])
                at = np.array([b + s for b, own_starts in zip(begins.tolist(), starts, strict=True) for s in own_starts], dtype=np.int32)
                _, keys = walk.keys(at, joined, None)
                names = [(n, s) for n, own_starts in zip(own, starts, strict=True) for s in own_starts]
                for name, key in zip(names, keys.tolist(), strict=True):
                    walk.items.setdefault(key, []).append(name)
                for k in range(len(walk.steps)):
                    _, found = _Walk(walk.back, walk.start, walk.steps[: k + 1], walk.moves).keys(at, joined, None)
                    if k == 0:
                        known = np.zeros(len(vocabulary) + 2, dtype=bool)
                        known[found.astype(np.int64) - 1] = True
                    else:
                        known = np.unique(found)
                    walk.prefixes.append(known)
                walks.append(walk)
            index.classes.append(walks)
        return index

    def distance(self, item: int, text: np.ndarray) -> tuple[int, int]:
        """Least edit distance of the item to a part of the text, and the (first) end of such a part."""
        mask, m = self.masks[item], self.lengths[item]
        high, full = 1 << (m - 1), (1 << m) - 1
        up, down, score, best, end = full, 0, m, m, 0
        for p, t in enumerate(text.tolist(), 1):
            equal = mask.get(t, 0)
            x = equal | down
            d0 = ((((equal & up) + up) ^ up) | x) & full
            plus, minus = (down | ~(d0 | up)) & full, up & d0
            score += bool(plus & high) - bool(minus & high)
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = (minus | ~(d0 | plus)) & full, plus & d0
            if score < best:
                best, end = score, p
        return best, end

    def leaks(self, texts: list[str | None], batch: int = 1 << 18) -> list[list[dict]]:
        """For each text the items found in it, each once at its least distance (earliest end): item_id, distance,
        n_words (of the item), start and end (words of the text). About `batch` words are walked at a time."""
        get, out, held, size = self.vocabulary.get, [], [], 0
        for text in texts:
            found = words(text)
            held.append(np.fromiter(map(get, found, repeat(0)), dtype=np.int32, count=len(found)))
            size += len(found)
            if size >= batch:
                out += self._found(held)
                held, size = [], 0
        return out + self._found(held)

    def _found(self, texts: list[np.ndarray]) -> list[list[dict]]:
        pad = np.full(32, len(self.vocabulary) + 1, dtype=np.int32)
        joined = np.concatenate([pad, *(part for t in texts for part in (t, pad))])
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.cumsum(np.concatenate([[0], lengths + len(pad)])) + len(pad)
        places = np.flatnonzero(joined <= len(self.vocabulary)).astype(np.int32)
        ends = (len(joined) - 1 - places[::-1]).astype(np.int32)
        turned = np.ascontiguousarray(joined[::-1])
        candidates: set[tuple[int, int, int]] = set()  # number of the text, item, place of its first word
        for walks in self.classes:
            for walk in walks:
                at, keys = walk.keys(ends if walk.back else places, turned if walk.back else joined, walk.prefixes)
                where = len(joined) - 1 - at if walk.back else at
                own = np.searchsorted(begins, where, side="right") - 1
                for n, place, key in zip(own.tolist(), (where - begins[own]).tolist(), keys.tolist(), strict=True):
                    for item, start in walk.items.get(key, ()):
                        candidates.add((n, item, place + start - self.lengths[item] + 1 if walk.back else place - start))
        for at, keys, items in self.pieces.met(joined, places):
            own = np.searchsorted(begins, at, side="right") - 1
            for n, place, key in zip(own.tolist(), (at - begins[own]).tolist(), keys.tolist(), strict=True):
                for item, first in items.get(key, ()):
                    candidates.add((n, item, place - first))
        best: list[dict[int, dict]] = [{} for _ in texts]
        parts: list[tuple[int, int, int, int]] = []  # text, item, and where they may meet: parts that overlap are one
        for n, item, place in sorted(candidates):
            most = int(self.ratio * self.lengths[item])
            low, high = max(0, place - most), min(len(texts[n]), place + self.lengths[item] + most)
            if parts and parts[-1][:2] == (n, item) and low < parts[-1][3]:
                low, high = parts[-1][2], max(high, parts.pop()[3])
            parts.append((n, item, low, high))
        for n, item, low, high in parts:
            m, tokens = self.lengths[item], texts[n]
            most = int(self.ratio * m)
            part = tokens[low:high]
            known = self.masks[item]
            if sum(t in known for t in part.tolist()) < m - most:
                continue
            distance, end = self.distance(item, part)
            if distance <= most:
                found = {"item_id": self.item_ids[item], "distance": distance, "n_words": m, "start": max(low, low + end - m), "end": low + end}
                old = best[n].get(item)
                if old is None or (distance, found["end"]) < (old["distance"], old["end"]):
                    best[n][item] = found
        return [[b[i] for i in sorted(b)] for b in best]


def blocks(benchmark: DataFrame, size: int = 20000) -> Iterator[Index]:
    """The benchmark's items in blocks of at most `size` (by ranges of item_id: more where one id has more), read one at a time.
    Items without an id or a word take no part; rows that repeat one take part once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    parts = -(-items.count() // size)
    cuts = items.stat.approxQuantile("item_id", [i / (2 * parts) for i in range(1, 2 * parts)], 0.0) if parts > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    for low, high in zip(edges, edges[1:], strict=False) if parts else ():
        part = items.where((F.lit(True) if low is None else F.col("item_id") >= low) & (F.lit(True) if high is None else F.col("item_id") < high))
        if rows := part.orderBy("item_id", "text").collect():
            yield Index.build([(r.item_id, r.text) for r in rows])


def _found(docs: DataFrame, shared: Broadcast) -> Column:
    """The items of one block that are found in the whole text; null, empty and wordless texts have none."""

    @F.pandas_udf(LEAKS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaks(texts.tolist()), dtype=object)

    return found("text")


def _each(benchmark: DataFrame, size: int, use: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """What `use` makes of each block; of several, each result is written, and the block let go, before the next is built."""
    held, context = None, benchmark.sparkSession.sparkContext
    for index in blocks(benchmark, size):
        if held is not None:
            yield cut(use(held))
            held.destroy()
        held = context.broadcast(index)
    if held is not None:
        yield use(held)


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 20000) -> DataFrame:
    """doc_id, item_id, distance, n_words, start, end of each benchmark item found in each row of docs. Repeated
    rows are reported each. Empty tables give an empty result; other columns of both tables are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = lambda shared: rows.select("doc_id", F.explode(_found(rows, shared)).alias("leak")).select("doc_id", "leak.*")
    none = rows.select("doc_id", F.explode(F.array().cast(LEAKS)).alias("leak")).select("doc_id", "leak.*")
    return reduce(DataFrame.union, _each(benchmark, size, found), none.limit(0))


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 20000) -> DataFrame:
    """The rows of docs in which no benchmark item is found; columns stay as they are. A block of items after the other, on what is left."""
    left = [docs]
    for kept in _each(benchmark, size, lambda shared: left[0].where(F.size(_found(left[0], shared)) == 0)):
        left[0] = kept
    return left[0]
