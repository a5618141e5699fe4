"""Byte-level BPE encoding and decoding by longest matches with backtracking.

A text is split by the vocabulary's pattern, and each match is encoded by itself. The merges of a byte string, lowest rank
first, give the one sequence of tokens in which every two neighbours are compatible: merging the bytes of just these two gives the same
two again. So no merges are carried out over a piece: it is walked from left to right, at each place with the longest
token that an Aho-Corasick automaton finds there (bytes as Latin-1 characters), then with shorter ones, as long as a token doesn't
fit to the one before it. Where none fits, the last token is taken back. What stands before a place that can be reached at all is
unique, so a place that has led nowhere is never tried again: the time is linear in the piece.

Whether two tokens fit is remembered, as are the ids of short pieces; both memories are bounded. Texts are taken as they come, one row at a
time, by all tasks: there is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import fresh

#: Pieces of a text that are looked up at once, characters of a piece that is remembered, remembered pieces.
BLOCK, SHORT, REMEMBERED = 1 << 16, 48, 300_000
#: A character that is no letter, number or white space.
_MARK = "!"


def read_ranks(path: str) -> bytes:
    """The content of a rank file (a token in base64 and its rank a line); a few hundred KB that every executor gets."""
    with open(path, "rb") as file:
        return file.read()


class _Ids(dict):
    """piece -> its ids as bytes (little-endian, 32 bits); what isn't there yet is encoded and, if it is short, kept."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if not piece.isascii() and any(map(self.codec.newer, piece)):
            raise _Newer
        ids = np.array(self.codec.tokens(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class _Newer(Exception):
    """A character that the two libraries put into different classes."""


class Codec:
    """A vocabulary of byte strings by rank with the pattern that splits texts."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.rank = {base64.b64decode(token): int(number) for token, number in map(bytes.split, ranks.splitlines())}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"no token for the bytes {missing}")
        self.bytes_of = {number: token for token, number in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, number in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), number)
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self.fits = lru_cache(1 << 19)(self._fits)
        self.shorter = lru_cache(1 << 17)(self._shorter)
        self.newer = lru_cache(1 << 14)(self._newer)
        self.ids = _Ids(self)

    def merged(self, content: bytes) -> list[int]:
        """The tokens of a short byte string by its merges: always the neighbours whose bytes together have the lowest rank, the first of
        equals."""
        parts = [content[i : i + 1] for i in range(len(content))]
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def _fits(self, left: int | None, right: int) -> bool:
        if left is None:
            return self.merged(self.bytes_of[right]) == [right]
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a true beginning of a token."""
        content = self.bytes_of[token]
        return next((self.rank[content[:n]] for n in range(len(content) - 1, 0, -1) if content[:n] in self.rank), None)

    def tokens(self, piece: bytes) -> list[int]:
        """The tokens of a piece, the same as by its merges; a piece that is a token is that token, merges or not."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        size = len(piece)
        longest = [0] * size
        lengths = self.bytes_of
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - len(lengths[token])] = token  # matches of one start come from short to long
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0] if size else None
        while at < size:
            before = out[-1] if out else None
            while token is not None and (dead[at + len(lengths[token])] or not self.fits(before, token)):
                token = self.shorter(token)
            if token is not None:
                out.append(token)
                at += len(lengths[token])
                token = longest[at] if at < size else None
            else:
                dead[at] = 1
                last = out.pop()
                at -= len(lengths[last])
                token = self.shorter(last)
        return out

    def _newer(self, char: str) -> bool:
        """The pattern library knows a character as a letter or a number that the tokenizer's library doesn't know yet."""
        return any(bool(regex.match(kind, char)) != bool(_matcher(kind).encode_ordinary(char)) for kind in (r"\p{L}", r"\p{N}"))

    def _pieces(self, text: str) -> Iterator[str]:
        """The matches of the pattern, for texts with characters that only one of the libraries knows: these count as marks."""
        known = text.translate({ord(c): _MARK for c in set(text) if not c.isascii() and self.newer(c)})
        return (text[m.start() : m.end()] for m in self.pattern.finditer(known))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit numbers."""
        pieces = iter(self.pattern.findall(text)) if len(text) <= 1 << 20 else (m.group() for m in self.pattern.finditer(text))
        out = []
        try:
            while block := list(islice(pieces, BLOCK)):
                out.append(b"".join(map(self.ids.__getitem__, block)))
        except _Newer:
            pieces, out = self._pieces(text), []
            while block := list(islice(pieces, BLOCK)):
                out += [np.array(self.tokens(p.encode()), dtype="<u4").tobytes() for p in block]
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; one that the vocabulary doesn't have is an error."""
        return b"".join(b"".join(map(self.bytes_of.__getitem__, ids[i : i + BLOCK].tolist())) for i in range(0, len(ids), BLOCK))


@lru_cache(8)
def _matcher(pattern: str) -> tiktoken.Encoding:
    """Encodes what a pattern matches, and nothing else, as bytes."""
    return tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})


@lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32)))


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column ids (array<int>): the tokens of the whole text, the same as the tokenizer's library gives for its ordinary text. A null text
    counts as empty and has no ids. If docs has a column of that name the new one has underscores before it; no column is replaced. Repeated rows are encoded
    each; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        codec = _codec(shared.value, pattern)
        return _lists([codec.encode(t.as_py() or "") for t in texts])

    return docs.withColumn(fresh(docs, ids), run(F.col(text)))


def decode(rows: DataFrame, ranks: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with a column decoded (binary): the bytes that the ids stand for, which are a text where the ids are those of a text. Null ids give null; names as in
    encode. An id that the vocabulary doesn't have is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        codec = _codec(shared.value, "")
        return pa.array([None if not x.is_valid else codec.decode(x.values.to_numpy(zero_copy_only=False)) for x in lists], pa.binary())

    return rows.withColumn(fresh(rows, decoded), run(F.col(ids)))


def digest(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers), decoded_sha256 (of the bytes that the ids give) of each row: encode and
    decode in one pass, so that neither ids nor texts are written."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            sizes, ids_sha, decoded_sha = [], [], []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py() or "")
                sizes.append(len(ids))
                ids_sha.append(sha(ids))
                decoded_sha.append(sha(codec.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
