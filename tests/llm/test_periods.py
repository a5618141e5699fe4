"""Runs against all periods tried at all places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.llm import periods, queries
from corvine.sources.tables import table


def brute(ids, least=12):
    """Of each period every stretch that can't be made longer; of those that have a smaller one too, that one's."""
    found = {}
    ids = np.array(ids, dtype=np.int64)
    for q in range(1, len(ids) // 2 + 1):
        same = np.r_[False, ids[:-q] == ids[q:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(least, 2 * q):
                found.setdefault((a, b - a + q), q)
    return sorted((a, n, q) for (a, n), q in found.items())


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_few_words(ids):
    assert periods.runs_of(ids) == brute(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 6), min_size=1, max_size=25), st.integers(1, 5), st.integers(0, 24)), max_size=8))
def test_nested_repeats(parts):
    """Blocks that repeat, with a rest, side by side; and all of it twice."""
    ids = [x for block, times, rest in parts for x in block * times + block[:rest]]
    for s in (ids, ids + ids, ids + [99] + ids):
        assert periods.runs_of(s) == brute(s)


@pytest.mark.parametrize("ids", [[0] * 500, [0, 1] * 200, list(range(300)) * 3, list(range(600)), [0] * 11, [0] * 12, list(range(6)) * 2, [*range(5), 7] * 2 + [9] + [*range(5), 7] * 2])
def test_plain_shapes(ids):
    assert periods.runs_of(ids) == brute(ids)


def test_words_that_grow():
    """Fibonacci and square-free words, which have very many runs and very few."""
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert periods.runs_of(b) == brute(b)
    free = [0]
    while len(free) < 1500:
        free = [y for x in free for y in ([0, 1, 2], [0, 2], [1])[x]]
    assert periods.runs_of(free) == brute(free) == []


def test_many_different_words():
    r = random.Random(1)
    ids = [r.randrange(1 << 21) for _ in range(300)]
    ids = ids[:100] * 3 + [(1 << 21) + 5] + ids[200:230] * 2 + ids
    assert periods.runs_of(ids) == brute(ids)


def test_long_text():
    r = random.Random(2)
    ids = [r.randrange(3000) for _ in range(60_000)]
    ids[10_000:30_000] = [ids[10_000 + i % 7000] for i in range(20_000)]
    ids[40_000:40_100] = [ids[40_000 + i % 9] for i in range(100)]
    got = periods.runs_of(ids)
    assert (10_000, 20_000, 7000) in [(a, n, q) for a, n, q in got if n == 20_000]
    assert any(a <= 40_000 and a + n >= 40_100 and q == 9 for a, n, q in got)


def plain(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = brute([names[w] for w in words])
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(top or (None,) * 3), None if top is None else top[1] * 1000 // top[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark, folder):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, folder).collect()}
    assert got == {r.doc_id: plain(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()}


def test_odd_rows(spark):
    line = "one two three\tfour five six\n"
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, line * 5), (4, line * 9), (4, line * 9), (5, "é " * 30), (30, line * 2 + "x " + line * 3), (6, "word " * 20_000), *((i, line * 4) for i in range(100, 130))]
    docs = spark.createDataFrame([(*r, 7, "n") for r in rows], "doc_id int, text string, runs int, collapsed string")
    got = sorted((tuple(r) for r in periods.digest(docs, queries.repeated_tail).collect()), key=str)
    expected = sorted(((i, *plain(i, t)) for i, t in rows if i != 6), key=str)
    assert [g for g in got if g[0] != 6] == expected
    assert next(g for g in got if g[0] == 6)[1:6] == (1, 0, 20_000, 1, 20_000_000)
    assert periods.digest(docs.limit(0)).count() == 0
    shown = periods.with_runs(docs)
    assert shown.columns == ["doc_id", "text", "runs", "collapsed", "_runs", "_collapsed"]
    by_text = {r.text: r for r in shown.collect()}
    assert by_text["é " * 30]._collapsed == "é" and [tuple(x) for x in by_text["é " * 30]._runs] == [(0, 30, 1)]
    assert by_text[None]._collapsed is None and by_text[""]._collapsed == "" and by_text[None].runs == 7
    assert periods.with_runs(docs.limit(0)).count() == 0
