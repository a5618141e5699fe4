"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The segmentation of a text is a path of pieces, the best one in the max-plus algebra. For a unigram model an edge of the
path lattice weighs its piece's score. For a BPE model the encoding is the one path on which every two
neighbouring pieces are compatible: encoding just these two again gives the same two pieces. So an edge
weighs 0 where the neighbours are compatible and minus infinity where not.

A giant document is cut into chunks. A state at a cut is the number of characters by which a piece reaches over it,
for BPE with that piece (or the one that ends there). Each chunk yields its matrix of best weights from each
state at its beginning to each state at its end. As max-plus products are associative, they are made over groups of FAN
neighbours, then over groups of these, up to the whole document; then each group, knowing its own first and last state, finds
the states between its members, down to the chunks; and each chunk traces its part back alone. A blank that follows another character can't be crossed by a piece (nor can a character
without a piece), so inside a chunk only the parts before the first and behind the last such place
depend on the states; what lies between is encoded by the library, as are whole documents that are one
chunk. Cuts fall on such places where there are any near.
"""

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from corvine.llm.common import cut, fresh

BLANK = "▁"
OTHER = -1  # a character without a piece: encoded as bytes
CHUNK, GIANT, REACH, FAN = 8192, 16384, 64, 16
NEVER = float("-inf")
UNIGRAM, BPE = 1, 2  # kinds of models
UNKNOWN = 10.0  # by how much a character without a piece is worse than the worst piece


class Model:
    """A model read on an executor: the library's processor for it."""

    def __init__(self, content: bytes) -> None:
        self.proto = proto.ModelProto()
        self.proto.ParseFromString(content)
        spec = self.proto.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or self.proto.trainer_spec.model_type not in (UNIGRAM, BPE) or not self.proto.trainer_spec.byte_fallback:
            raise ValueError("needs a BPE or unigram model with byte fallback that keeps texts as they are")
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)


class Pieces(Model):
    """A model with what the lattice needs."""

    def __init__(self, content: bytes) -> None:
        super().__init__(content)
        self.proto.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=self.proto.SerializeToString())
        self.ids = {p.piece: i for i, p in enumerate(self.proto.pieces) if p.type == 1}
        self.names = [p.piece for p in self.proto.pieces]
        self.characters = {c for p in self.ids for c in p}
        self.longest = max(map(len, self.ids))
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("pieces cross blanks")
        self.compatible = lru_cache(1 << 18)(self._compatible)
        self.alone = lru_cache(1 << 16)(lambda piece: self.bare.encode(self.names[piece]) == [piece])

    def _compatible(self, left: int | None, right: int) -> bool:
        if left is None or left == OTHER or right == OTHER:
            return right == OTHER or self.alone(right)
        return self.bare.encode(self.names[left] + self.names[right]) == [left, right]

    def free(self, text: str, p: int) -> bool:
        """No piece crosses position p."""
        a, b = text[p - 1], text[p]
        return (b == BLANK and a != BLANK) or a not in self.characters or b not in self.characters

    def ending(self, text: str, end: int, least: int) -> Iterator[tuple[int, int]]:
        """(start, piece) of the pieces that end at `end` and start at `least` or later."""
        if text[end - 1] not in self.characters:
            if end - 1 >= least:
                yield end - 1, OTHER
            return
        for start in range(end - 1, max(least, end - self.longest) - 1, -1):
            piece = self.ids.get(text[start:end])
            if piece is not None:
                yield start, piece

    def states(self, text: str, cut: int) -> list[tuple[int, int | None]]:
        """(reach, piece) of the states at a cut; a place that no piece crosses has the state (0, None)."""
        if cut == 0 or cut == len(text) or self.free(text, cut):
            return [(0, None)]
        return [(end - cut, piece) for end in range(cut, min(len(text), cut + self.longest) + 1) for start, piece in self.ending(text, end, 0) if start < cut]

    def forward(self, text: str, begin: int, end: int, entries: list[tuple[int, int | None]], exits: list[tuple[int, int | None]]) -> dict:
        """Nodes (position, last piece) that paths from the entries at `begin` reach, with the bit set of those
        entries and the nodes before; pieces start before `end`."""
        nodes: dict[int, dict[int | None, tuple[int, list]]] = {}
        for k, (reach, piece) in enumerate(entries):
            here = nodes.setdefault(begin + reach, {})
            here[piece] = (here.get(piece, (0, []))[0] | 1 << k, [])
        for stop in range(begin + 1, max([end, *(end + r for r, _ in exits)]) + 1):
            for start, piece in self.ending(text, stop, begin):
                if start >= end or start not in nodes:
                    continue
                for before, (mask, _) in nodes[start].items():
                    if self.compatible(before, piece):
                        here = nodes.setdefault(stop, {})
                        old, froms = here.get(piece, (0, []))
                        here[piece] = (old | mask, [*froms, (start, before)])
        return nodes

    def weights(self, text: str, begin: int, end: int, entries: list, exits: list) -> np.ndarray:
        """Max-plus matrix of the paths between two places of the text."""
        nodes = self.forward(text, begin, end, entries, exits)
        out = np.full((len(entries), len(exits)), NEVER)
        for j, (reach, piece) in enumerate(exits):
            here = nodes.get(end + reach, {})
            for last, (mask, _) in here.items():
                if piece is None or last == piece:
                    for k in range(len(entries)):
                        if mask >> k & 1:
                            out[k, j] = 0.0
        return out

    def trace(self, text: str, begin: int, end: int, entry: tuple, leave: tuple) -> list[int]:
        """The ids of the path from one state to another, without the piece of the first."""
        nodes = self.forward(text, begin, end, [entry], [leave])
        at = end + leave[0]
        last = leave[1] if leave[1] is not None else next(iter(nodes[at]))
        out: list[int] = []
        while (froms := nodes[at][last][1]) and not (at == begin + entry[0] and last == entry[1]):
            start, before = froms[0]
            out[:0] = self.bare.encode(text[start:at]) if last == OTHER else [last]
            at, last = start, before
        return out

    def inner(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and the last place in a chunk that no piece crosses."""
        first = next((p for p in range(begin + self.longest, end) if self.free(text, p)), None)
        return None if first is None else (first, next(p for p in range(end - 1, first - 1, -1) if self.free(text, p)))

    def chunk(self, left: str, body: str, right: str) -> tuple[str, int, int, list, list]:
        text = left + body + right
        begin, end = len(left), len(left) + len(body)
        return text, begin, end, self.states(text, begin), self.states(text, end)

    def matrix(self, left: str, body: str, right: str) -> np.ndarray:
        text, begin, end, entries, exits = self.chunk(left, body, right)
        if (places := self.inner(text, begin, end)) is None:
            return self.weights(text, begin, end, entries, exits)
        return self.weights(text, begin, places[0], entries, [(0, None)]) + self.weights(text, places[1], end, [(0, None)], exits)

    def ends(self, left: str, body: str, right: str) -> str:
        """What a chunk's matrix depends on of its body, from which it comes out the same: what lies before the first and behind the last place that no
        piece crosses, with a character beyond each, by which these places stay such."""
        text, begin, end = left + body + right, len(left), len(left) + len(body)
        places = self.inner(text, begin, end)
        return body if places is None or places[1] - places[0] <= 2 else text[begin : places[0] + 1] + text[places[1] - 1 : end]

    def part(self, left: str, body: str, right: str, entry: int, leave: int) -> list[int]:
        """The ids of a chunk's pieces between the states with these numbers: pieces that start in the chunk."""
        text, begin, end, entries, exits = self.chunk(left, body, right)
        if (places := self.inner(text, begin, end)) is None:
            return self.trace(text, begin, end, entries[entry], exits[leave])
        head = self.trace(text, begin, places[0], entries[entry], (0, None))
        return head + self.bare.encode(text[places[0] : places[1]]) + self.trace(text, places[1], end, (0, None), exits[leave])

    def cuts(self, text: str, size: int) -> list[int]:
        """Where a normalised text is cut: at a free place in the last part of each chunk, if there is one."""
        out = [0]
        while len(text) - out[-1] > size + max(REACH, size // 4):
            want = out[-1] + size
            out.append(next((p for p in range(want, want - size // 4, -1) if self.free(text, p)), want))
        return [*out, len(text)]


class Unigram(Pieces):
    """The lattice of a unigram model: a node is a place, a state how far a piece reaches over a cut."""

    def __init__(self, content: bytes) -> None:
        super().__init__(content)
        self.score = {i: p.score for i, p in enumerate(self.proto.pieces) if p.type == 1}
        self.other = min(self.score.values()) - UNKNOWN

    def states(self, text: str, cut: int) -> list[tuple[int, int | None]]:
        if cut == 0 or cut == len(text) or self.free(text, cut):
            return [(0, None)]
        return [(reach, None) for reach in range(min(self.longest, len(text) - cut + 1))]

    def reached(self, text: str, begin: int, end: int, entries: list, exits: list) -> tuple[dict, dict]:
        """Of each place that paths from the entries reach the best weight from each entry, and of the first entry the last
        piece and where it starts. Pieces start before `end`."""
        best: dict[int, np.ndarray] = {}
        for k, (reach, _) in enumerate(entries):
            best.setdefault(begin + reach, np.full(len(entries), NEVER))[k] = 0.0
        back: dict[int, tuple[int, int]] = {}
        furthest = end + max(r for r, _ in exits)
        for start in range(begin, end):
            if start not in best:
                continue
            for stop in range(start + 1, min(furthest, start + self.longest) + 1):
                piece = self.ids.get(text[start:stop])
                if piece is None and (stop > start + 1):
                    continue
                here = best[start] + (self.other if piece is None else self.score[piece])
                old = best.get(stop)
                if old is None or here[0] > old[0]:
                    back[stop] = (start, OTHER if piece is None else piece)
                best[stop] = here if old is None else np.maximum(old, here)
        return best, back

    def weights(self, text: str, begin: int, end: int, entries: list, exits: list) -> np.ndarray:
        best, _ = self.reached(text, begin, end, entries, exits)
        none = np.full(len(entries), NEVER)
        return np.stack([best.get(end + reach, none) for reach, _ in exits], axis=1)

    def trace(self, text: str, begin: int, end: int, entry: tuple, leave: tuple) -> list[int]:
        _, back = self.reached(text, begin, end, [entry], [leave])
        at, out = end + leave[0], []
        while at > begin + entry[0]:
            start, piece = back[at]
            out[:0] = self.bare.encode(text[start:at]) if piece == OTHER else [piece]
            at = start
        return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def states_between(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The state at each end of the matrices on the best path from one state to another: products from the front and from the
    back meet there."""
    front, back = [], []
    for m in matrices[:-1]:
        front.append(m[entry] if not front else (front[-1][:, None] + m).max(0))
    for m in reversed(matrices[1:]):
        back.append(m[:, leave] if not back else (m + back[-1][None, :]).max(1))
    total = [f + b for f, b in zip(front, reversed(back), strict=True)]
    if any(t.max() == NEVER for t in total):
        raise ValueError("no path: the model's pieces do not follow from its merges")
    return [entry, *(int(np.argmax(t)) for t in total), leave]


MATRIX = "key string, n int, rows int, weights array<double>"


def _matrices(part: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(w).reshape(r, -1) for w, r in zip(part["weights"], part["rows"], strict=True)]


def scan(leaves: DataFrame) -> DataFrame:
    """key, n, entry, leave: the states at both ends of each chunk on the best path, from the chunks' matrices."""

    def combined(part: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(product, _matrices(part.sort_values("n")))
        return pd.DataFrame({"key": part["key"].iloc[:1], "n": part["up"].iloc[:1], "rows": [len(whole)], "weights": [whole.ravel()]})

    def parted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        states = states_between(_matrices(part), int(part["entry"].iloc[0]), int(part["leave"].iloc[0]))
        return pd.DataFrame({"key": part["key"], "n": part["n"], "entry": states[:-1], "leave": states[1:]})

    up = lambda level: level.withColumn("up", F.floor(F.col("n") / FAN).cast("int"))
    levels = [cut(leaves)]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 0:
        levels.append(cut(up(levels[-1]).groupBy("key", "up").applyInPandas(combined, MATRIX)))
    states = levels[-1].select("key", "n", F.lit(0).alias("entry"), F.lit(0).alias("leave"))  # a text begins and ends in one state
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("n", "up")
        states = up(level).join(above, ["key", "up"]).groupBy("key", "up").applyInPandas(parted, "key string, n int, entry int, leave int")
    return states


_loaded: dict[tuple, Model] = {}


def pieces_of(content: bytes) -> Pieces:
    return Unigram(content) if Model(content).proto.trainer_spec.model_type == UNIGRAM else Pieces(content)


def _load(content: bytes, kind: Callable[[bytes], Model] = Model):
    """A model is read once by each Python worker."""
    key = (kind, content)
    if key not in _loaded:
        _loaded[key] = kind(content)
    return _loaded[key]


def _rows_of(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Slices: lists of Python numbers stay small."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def read_model(path: str) -> bytes:
    """The content of a model file; a few hundred KB that every executor gets."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes, chunk: int = CHUNK, giant: int = GIANT, decoded: bool = False) -> DataFrame:
    """docs with a column ids (array<int>; replaces a column of that name): the pieces of the whole text, the
    same as the library's for any chunk and giant (of a unigram model's equally good paths, one). Null texts have null ids, empty ones no ids; repeated
    rows are encoded each (giant ones once). decoded: a column decoded as well, the text that the ids give. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded]
    docs = docs.drop(*[f.name for f in added])
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, *added])

    def whole(batches):
        own = _load(shared.value)
        for batch in batches:
            for rows in _rows_of(batch):
                texts = rows.column("text").to_pylist()
                found = own.processor.encode([t or "" for t in texts], num_threads=1)
                ids = pa.array([None if t is None else f for t, f in zip(texts, found, strict=True)], pa.list_(pa.int32()))
                back = [pa.array([None if t is None else own.processor.decode(f) for t, f in zip(texts, found, strict=True)], pa.string())] * decoded
                yield pa.RecordBatch.from_arrays([*rows.columns, ids, *back], names=schema.names)

    small = docs.where(F.col("text").isNull() | (F.length("text") <= giant)).mapInArrow(whole, schema)
    large = docs.where(F.length("text") > giant)
    pieces_schema = pa.schema([("key", pa.string()), ("n", pa.int32()), ("left", pa.string()), ("body", pa.string()), ("right", pa.string())])

    def cut_up(batches, only_ends):
        own = _load(shared.value, pieces_of)
        for batch in batches:
            for rows in _rows_of(batch, 8):
                for key, text in zip(rows.column("key").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    text = BLANK + text.replace(" ", BLANK)
                    at = own.cuts(text, chunk)
                    for n, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                        left, body, right = text[max(0, a - REACH) : a], text[a:b], text[b : b + REACH]
                        yield pa.RecordBatch.from_pylist([{"key": key, "n": n, "left": left, "body": own.ends(left, body, right) if only_ends else body, "right": right}], schema=pieces_schema)

    def chunks(only_ends: bool) -> DataFrame:
        """A giant text's chunks, which its copies share."""
        texts = large.select(F.sha2("text", 256).alias("key"), "text")
        return texts.mapInArrow(lambda batches: cut_up(batches, only_ends), "key string, n int, left string, body string, right string").dropDuplicates(["key", "n"])

    # A giant text is shuffled once, as chunks that meet their states; before, the matrices are made of the chunks' ends. The texts are cut for each of
    # the two: chunks kept in between would take more disk and be shuffled again.
    key = fresh(docs, "key")
    narrow = "smallint" if _load(model).processor.get_piece_size() <= 2**15 else "int"

    def matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _load(shared.value, pieces_of)
        for part in parts:
            found = [own.matrix(*x) for x in zip(part["left"], part["body"], part["right"], strict=True)]
            yield pd.DataFrame({"key": part["key"], "n": part["n"], "rows": [len(m) for m in found], "weights": [m.ravel().tolist() for m in found]})

    def traced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _load(shared.value, pieces_of)
        for part in parts:
            for at in range(0, len(part), 64):  # lists of Python numbers stay small
                some = part.iloc[at : at + 64]
                found, shown = [], []
                for x in zip(some["left"], some["body"], some["right"], some["entry"], some["leave"], strict=True):
                    ids = own.part(*x)
                    found.append(np.array(ids, dtype=np.int16 if narrow == "smallint" else np.int32))
                    shown.append(own.bare.decode(ids) if decoded else "")
                yield pd.DataFrame({"key": some["key"], "n": some["n"], "part": found, "shown": shown})

    parts = chunks(False).join(scan(chunks(True).mapInPandas(matrices, MATRIX)), ["key", "n"]).mapInPandas(traced, f"key string, n int, part array<{narrow}>, shown string")
    joined = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "part", "shown"))).alias("parts"))
    back = [F.substring(F.array_join("parts.shown", ""), 2, 2**31 - 1).alias("decoded")] * decoded  # without the blank that encoding puts first
    joined = joined.select(F.col("key").alias(key), F.flatten("parts.part").cast("array<int>").alias("ids"), *back)
    # the key is a column before the join, so that a caller who drops the text has it left out of the shuffle
    return small.unionByName(large.withColumn(key, F.sha2("text", 256)).join(joined, key).select(*columns, *[f.name for f in added]))


def decode(rows: DataFrame, model: bytes, many: int = GIANT) -> DataFrame:
    """rows (with a column ids) with a column decoded (replaces one of that name): their text; null for null ids. Over `many` ids are
    decoded in parts of that size, which tasks share and which meet again as texts (those of equal ids once)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop("decoded")
    columns = rows.columns

    def run(batches):
        own = _load(shared.value)
        for batch in batches:
            for part in _rows_of(batch):
                texts = [None if i is None else own.processor.decode(i) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    small = rows.where(F.col("ids").isNull() | (F.size("ids") <= many)).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
    large, key = rows.where(F.size("ids") > many), fresh(rows, "key")
    name = F.sha2(F.array_join("ids", ","), 256)

    def cut_up(batches):
        own = _load(shared.value, pieces_of)
        single = np.array([p.type == 6 for p in own.proto.pieces])  # bytes of a character stay together
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids, at = np.array(ids, dtype=np.int32), [0]
                while at[-1] < len(ids):
                    end = min(len(ids), at[-1] + many)
                    while end < len(ids) and single[ids[end]]:
                        end += 1
                    at.append(end)
                for n, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n], pa.int32()), pa.array([ids[a:b]], pa.list_(pa.int32()))], names=["key", "n", "part"])

    def shown(batches):
        own = _load(shared.value, pieces_of)
        for batch in batches:
            for part in _rows_of(batch):
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), pa.array([own.bare.decode(i) for i in part.column("part").to_pylist()], pa.string())], names=["key", "n", "shown"])

    once = large.groupBy(name.alias("key")).agg(F.first("ids").alias("ids"))
    parts = once.mapInArrow(cut_up, "key string, n int, part array<int>").repartition(F.col("key"), F.col("n")).mapInArrow(shown, "key string, n int, shown string")
    joined = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "shown"))).alias("parts"))
    text = F.array_join("parts.shown", "")
    joined = joined.select(F.col("key").alias(key), F.when(F.startswith(text, F.lit(" ")), F.substring(text, 2, 2**31 - 1)).otherwise(text).alias("decoded"))
    return small.unionByName(large.join(joined, name == F.col(key)).select(*columns, "decoded"))


def round_trip(docs: DataFrame, model: bytes, **options) -> DataFrame:
    """doc_id, n_tokens, ids_hash (xxhash64 of the ids), decoded_sha256 and same (the text came back; one that
    holds U+2581, which stands for a blank, comes back with a blank in its place) for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.translate("text", BLANK, " "), 256).alias("wanted"))  # giant texts meet their ids as digests
    done = encode(rows, model, decoded=True, **options).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return done.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "decoded_sha256", F.coalesce(F.col("wanted") == F.col("decoded_sha256"), F.lit(True)).alias("same"))
