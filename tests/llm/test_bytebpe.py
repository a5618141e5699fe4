"""Byte-level BPE against the tokenizer's library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.llm import bytebpe, queries
from corvine.sources.tables import table

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def both(name):
    ranks = bytebpe.read_ranks(public_tokenizers.path(name))
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return bytebpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    return both(request.param)


CODEC, LIBRARY = both(FILES[0])


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_words_and_long_pieces(pair):
    codec, library = pair
    r = random.Random(4)
    letters = "abcdefghijklmnoprstuvwéüñ"
    texts = ["", " ", "\n" * 700, " " * 3001 + "x", "a" * 5000, "ab" * 3000, "1" * 2000, "don't you'll I've", "日本語のテキスト" * 50, "=-" * 900, "\r\n\t   x"]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 3000))) for _ in range(30)]
    texts += ["".join(r.choice("aeinrst") for _ in range(400)) for _ in range(60)] + ["".join(r.choice(" \n\tab.,;'’") for _ in range(200)) for _ in range(60)]
    tokens = sorted(codec.bytes_of)
    texts += [b"".join(codec.bytes_of[r.choice(tokens)] for _ in range(40)).decode("utf-8", "ignore") for _ in range(300)]
    for text in texts:
        assert codec.encode(text).tolist() == library.encode_ordinary(text), text[:80]
        assert codec.decode(codec.encode(text)) == text.encode()


def test_every_character(pair):
    """Also those that only one of the libraries knows, in words, numbers and alone."""
    codec, library = pair
    chars = [chr(c) for c in range(0x80, 0x110000, 7) if not 0xD800 <= c < 0xE000] + [chr(c) for c in (0x558, 0x58C, 0x88F, 0x11DE0, 0x12475, 0x3347A, 0xA7CE)]
    for i in range(0, len(chars), 500):
        text = " ".join(f"a{c}b 1{c}2 {c}" for c in chars[i : i + 500])
        assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_linear_time():
    """A piece that is all one token's letters, and one without any memory of it: no place is tried twice."""
    for text in ("a" * 200_000, "".join(random.Random(1).choice("etaoin") for _ in range(200_000))):
        seen = []
        fits, CODEC.fits = CODEC.fits, lambda a, b: (seen.append(1), fits(a, b))[1]  # noqa: B023
        try:
            assert b"".join(CODEC.bytes_of[t] for t in CODEC.tokens(text.encode())) == text.encode()
        finally:
            CODEC.fits = fits
        assert len(seen) < 4 * len(text)


def test_small_memory(monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 10)
    monkeypatch.setattr(bytebpe, "BLOCK", 7)
    codec, library = both(FILES[0])
    text = " ".join(f"word{i} and more" for i in range(300))
    assert codec.encode(text).tolist() == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode() and len(codec.ids) <= 10


def test_odd_rows(spark):
    ranks = bytebpe.read_ranks(public_tokenizers.path(FILES[0]))
    rows = [(1, None), (2, ""), (None, "é"), (4, "the same"), (4, "the same"), (5, "word " * 300_000), (6, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "taken", "n") for r in rows], "doc_id long, text string, ids string, Decoded string")
    got = bytebpe.decode(bytebpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, ids="_ids")
    assert got.columns == ["doc_id", "text", "ids", "Decoded", "_ids", "_decoded"]
    for r in got.collect():
        assert (r.ids, r.Decoded) == ("taken", "n")
        assert r._ids == LIBRARY.encode_ordinary(r.text or "") and bytes(r._decoded) == (r.text or "").encode()
    assert bytebpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    digests = bytebpe.digest(docs, ranks, public_tokenizers.PATTERN)
    assert digests.count() == len(rows) and digests.limit(0).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytebpe.decode(nulls, ranks).first().decoded is None


def test_query(spark, folder):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, folder).collect()}
    for r in table(spark, folder, "documents").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
