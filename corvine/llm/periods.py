"""Runs: stretches of words that repeat with a period, at least twice, and can't be made longer.

A text's words are numbered. In a suffix automaton of the numbers each state stands for the ends of one set of equal stretches; a state's ends
are those of the states that link to it, merged from the smaller ordered set into the larger one. Where two ends become neighbours there, at a distance d that
isn't larger than the state's length, the stretch that ends at the first meets or overlaps the one that ends at the second: a
square of period d. Extended to both sides as far as the words d apart are equal, it is a run, and every run is found so: the ends
of a run and of the run without its last period are neighbours among the ends of the latter.

An end that comes between later makes the period of a seed a multiple of the run's; such a seed extends to the same stretch, of which the
smallest period counts. Only the parts of a text that can hold a run get an automaton: of the three-word stretches of a run of
twelve words or more all but two in its middle come at least twice in the text, so that three neighbouring ones that come once part
what is looked at. A text is one row's work: there is no shuffle, and memory is in proportion to the longest such part (about 0.7 KB a word).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import fresh

#: Least length of a run in words, and words of a stretch by which parts without runs are told.
LEAST, GRAM = 12, 3
Run = tuple[int, int, int]


def words_of(text: str | None) -> list[bytes]:
    """The words [^ \\t-\\r]+ of a text as UTF-8 (bytes split at ASCII white space alone)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbers(words: list[bytes]) -> list[int]:
    """Equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the parts of a text outside of which no run of LEAST words lies."""
    if len(ids) < LEAST:
        return []
    size = int(ids.max()) + 1
    pairs = ids[:-1] * size + ids[1:]
    if size > 1 << 20:  # else the products fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, often = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(often[place] > 1)
    if not len(again):
        return []
    cuts = np.flatnonzero(np.diff(again) > GRAM)
    firsts, lasts = again[np.r_[0, cuts + 1]], again[np.r_[cuts, len(again) - 1]] + GRAM
    return [(int(a), int(b)) for a, b in zip(firsts, lasts, strict=True) if b - a >= LEAST]


def _automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, link and own end (-1: none) of the states of the suffix automaton; state 0 is the empty stretch."""
    length, link, end, edges = [0], [-1], [-1], [{}]
    last = 0
    for at, word in enumerate(ids):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        end.append(at)
        edges.append({})
        state = last
        while state >= 0 and word not in edges[state]:
            edges[state][word] = new
            state = link[state]
        if state >= 0:
            target = edges[state][word]
            if length[target] > length[state] + 1:  # the target holds longer stretches too: those up to this length part from them
                short = len(length)
                length.append(length[state] + 1)
                link.append(link[target])
                end.append(-1)
                edges.append(dict(edges[target]))
                while state >= 0 and edges[state].get(word) == target:
                    edges[state][word] = short
                    state = link[state]
                link[target] = short
                target = short
            link[new] = target
        last = new
    return length, link, end


def _seeds(ids: list[int]) -> Iterator[tuple[int, int]]:
    """(end, d) of squares that end there with period d; of every run at least one, with its smallest period."""
    length, link, end = _automaton(ids)
    ends: list[list[int] | None] = [None if e < 0 else [e] for e in end]
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up, small = link[state], ends[state]
        ends[state] = None
        if up == 0 or small is None:
            continue
        large = ends[up]
        if large is None:
            ends[up] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        reach = length[up]
        for e in small:
            at = bisect_left(large, e)
            if at and e - large[at - 1] <= reach:
                yield e, e - large[at - 1]
            if at < len(large) and large[at] - e <= reach:
                yield large[at], large[at] - e
            large.insert(at, e)
        ends[up] = large


def runs_of(ids: list[int], least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs of numbered words, by start, then period: smallest period q, `least` words (LEAST at least) and two periods at
    least, not to be extended on either side."""
    if least < LEAST:
        raise ValueError(f"runs have at least {LEAST} words")
    found: dict[tuple[int, int], int] = {}
    for first, stop in stretches(np.array(ids, dtype=np.int64)):
        part = ids[first:stop]
        size, covered = len(part), set()
        for e, d in _seeds(part):
            if (d, (e + 1) // d - 1) in covered:  # this whole block of d words lies in the square, and in one run of period d only
                continue
            start, end = e - d, e
            while start and part[start - 1] == part[start - 1 + d]:
                start -= 1
            while end + 1 < size and part[end + 1] == part[end + 1 - d]:
                end += 1
            covered.update((d, block) for block in range(-(-start // d), (end + 1) // d))
            if end - start + 1 >= max(least, 2 * d):
                key = (first + start, end - start + 1)
                found[key] = min(d, found.get(key, d))
    return sorted((start, length, period) for (start, length), period in found.items())


def dropped(size: int, runs: list[Run]) -> np.ndarray:
    """Which of `size` words a run holds behind its first period."""
    change = np.zeros(size + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:size] > 0


def collapsed(text: str | None, least: int = LEAST) -> tuple[list[Run], str]:
    """A text's runs, and its words without those that a run holds behind its first period, joined by one blank."""
    words = words_of(text)
    runs = runs_of(numbers(words), least)
    gone = dropped(len(words), runs)
    return runs, b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass")


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with columns runs (start, length, period in words, by start, then period) and collapsed (the text with one period of each run, its words joined by one
    blank; null for null). Columns of these names stay: the new ones get underscores before theirs. Empty texts have no runs; repeated rows and ties are
    reported each; an empty table gives an empty result."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @F.arrow_udf(f"struct<runs:{_RUNS},collapsed:string>")
    def run(texts: pa.Array) -> pa.Array:
        found = [collapsed(t.as_py(), least) for t in texts]
        shown = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _ in found], kind)
        kept = pa.array([text if t.is_valid else None for t, (_, text) in zip(texts, found, strict=True)], pa.string())
        return pa.StructArray.from_arrays([shown, kept], names=["runs", "collapsed"])

    held, runs, kept = fresh(docs, "held"), fresh(docs, "runs"), fresh(docs, "collapsed")
    return docs.withColumn(held, run(F.col(text))).withColumns({runs: F.col(f"{held}.runs"), kept: F.col(f"{held}.collapsed")}).drop(held)


def digest(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (1000 * length / period, rounded down) of the longest run (of equals that of the smallest start, then period;
    nulls without a run), runs_sha256 (of `start,length,period` and a line feed of each run), collapsed_sha256 of each row. change: what is to be made of
    a document's words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                words = words if change is None else change(key, words)
                runs = runs_of(numbers(words), least)
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                kept = words if not runs else [w for w, g in zip(words, dropped(len(words), runs).tolist(), strict=True) if not g]
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
                out.append((key, len(runs), start, length, period, None if length is None else 1000 * length // period, sha(listed), sha(b" ".join(kept))))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = ", ".join(f"{n} {'string' if n.endswith('256') else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
