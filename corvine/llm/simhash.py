"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in three bits at
most, one of their segments differs in one bit at most. So each segment is indexed by its own value and
by its variants with one bit deleted (a wildcard); an equality join on these keys meets every pair, and
the bit count of the exclusive or verifies it. A variant joins a segment with a 0 at the deleted bit
only to one with a 1 there: equal segments meet once, by their own value, and not in all 32 variants.

Copies never meet each other: the index holds distinct fingerprints. A segment value that very many
distinct fingerprints share (and its one-bit neighbours) is refined: the other segment, in which a link
has three differing bits at most, is cut in two and indexed in the same way under the first key.

Similar texts are found by the same deletion variants of a signature of other components: see without_similar.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.common import compact, components, cut, fresh, merging, written

SEED = 42
#: Set bits of each byte value, least significant first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of a text as an unsigned 64-bit number; 0 if it has no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) for each row; other columns are not read."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _keys(value: Column, bits: int, lead: Column) -> Column:
    """Index entries of a segment of `bits` bits: key (one long: lead, which bit is deleted, the rest) and
    side. Side 0 meets side 0 at the segment's own value; side 1 (the deleted bit was 0) meets side 2."""

    def entry(which: Column, rest: Column, side: Column) -> Column:
        return F.struct((lead * 2 ** (bits + 6) + which * 2**bits + rest).cast("long").alias("key"), side.cast("byte").alias("side"))

    def deleted(i: Column) -> Column:
        bit = F.pow(F.lit(2), i).cast("long")
        is_set = value.bitwiseAND(bit) != 0
        return entry(i.cast("long") + 1, F.when(is_set, value - bit).otherwise(value), F.when(is_set, 2).otherwise(1))

    return F.concat(F.array(entry(F.lit(0).cast("long"), value, F.lit(0))), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), deleted))


def _met(index: DataFrame, bits: int) -> DataFrame:
    """Verified links a < b among the rows of an index of key, side, fp. Its sides are merged: Spark sizes what was exploded as if it were not, and would
    send the whole index through the driver where the fingerprints alone are small enough to broadcast."""
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits
    x, y = index.hint("merge").alias("x"), index.hint("merge").alias("y")
    same = x.where("x.side = 0").join(y.where("y.side = 0"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near)
    apart = x.where("x.side = 1").join(y.where("y.side = 2"), (F.col("x.key") == F.col("y.key")) & near)
    return same.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).union(apart.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")))


def links(distinct: DataFrame, bits: int = 3, cell: int = 2000) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column fp) that differ in `bits` <= 3 bits at most. A
    link may come twice. cell: distinct fingerprints with one segment value beyond which it is refined;
    the result does not depend on it."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments hold up to three differing bits")
    # dealt by number: a fingerprint becomes 66 index entries, so few bytes here are many behind the next step
    # (by a hash of its own, as the optimizer leaves out a dealing that rows already have, and joins small partitions)
    distinct = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = distinct.select("fp", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("part"), low.alias("own"), high.alias("other")), F.struct(F.lit(1).cast("long").alias("part"), high.alias("own"), low.alias("other")))).alias("s")).select("fp", "s.*")
    full = cut(halves.groupBy("part", "own").count().where(F.col("count") > cell).select("part", "own"))
    around = F.concat(F.array("own"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("own").bitwiseXOR(F.pow(F.lit(2), i).cast("long"))))
    if full.isEmpty():
        calm, dense = halves, None
    else:  # a pair of which neither value is crowded meets among the calm rows, any other among the dense
        around_full = full.select("part", F.explode(around).alias("own")).distinct()
        calm, dense = halves.join(full, ["part", "own"], "left_anti"), halves.join(around_full, ["part", "own"], "left_semi")
    entries = lambda rows, keys: rows.select("fp", F.explode(keys).alias("e")).select("fp", "e.key", "e.side")
    found = _met(entries(calm, _keys(F.col("own"), 32, F.col("part"))), bits)
    if dense is not None:
        # Pairs with equal or one-bit-apart first segments, dealt by quarter of the other segment as well.
        first = dense.select("fp", "other", F.explode(_keys(F.col("own"), 32, F.col("part"))).alias("f")).select("fp", "f.key", F.col("f.side").alias("first"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("quarter"), F.col("other").bitwiseAND(F.lit(0xFFFF)).alias("piece")), F.struct(F.lit(1).cast("long").alias("quarter"), F.shiftrightunsigned("other", 16).alias("piece")))).alias("q"))
        fine = first.select("fp", "first", F.explode(_keys(F.col("q.piece"), 16, F.col("key") * 2 + F.col("q.quarter"))).alias("e")).select("fp", "first", "e.key", "e.side")
        x, y = fine.hint("merge").alias("x"), fine.hint("merge").alias("y")  # see _met
        meets = (F.col("x.key") == F.col("y.key")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits)
        for left, right, unordered in ((0, 0, True), (1, 2, False)):
            a, b = x.where(f"x.first = {left}"), y.where(f"y.first = {right}")
            for s, t in ((0, 0), (1, 2)) if unordered else ((0, 0), (1, 2), (2, 1)):
                pairs = a.where(f"x.side = {s}").join(b.where(f"y.side = {t}"), meets & (F.col("x.fp") != F.col("y.fp")))
                found = found.union(pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")))
    return found


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, cell: int = 2000) -> DataFrame:
    """doc_id, text_hash, fp, component (its least fingerprint), component_id (smallest doc_id reachable
    over links) for each row of docs.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id takes part; a
    component that has only null ids has a null component_id. Repeated rows are kept. An empty table
    gives an empty result; columns besides doc_id and text are ignored.
    """
    rows = cut(fingerprints(docs, words))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    joined = components(links(distinct.select("fp"), bits, cell)).withColumnRenamed("node", "fp")
    grouped = distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


#: Of similar texts: segments of a signature, values of a segment, and their hashes' fixed random numbers.
SEGMENTS, VALUES = 5, 6
_random = np.random.default_rng(2024)
_XOR, _ODD, _FOLD = (_random.integers(0, 2**64, n, dtype=np.uint64) for n in (SEGMENTS * VALUES, SEGMENTS * VALUES, VALUES))
_ODD, _FOLD, _NAME = _ODD | np.uint64(1), _FOLD | np.uint64(1), _random.integers(0, 2**64, (SEGMENTS, VALUES), dtype=np.uint64)
#: Nodes of a block, rounds of stars before blocks, nodes that are broadcast at most (8 MB), pairs that are (1 MB), nodes of keys that need no round.
BLOCK, ROUNDS, FEW, PAIRS, REST = 1024, 4, 1_000_000, 20_000, 4096


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, rising; of fewer words the whole sequence; none without a word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    shingles = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64))


def variants(hashes: np.ndarray) -> np.ndarray:
    """The keys of a text: of each segment of its signature (least hashes in random orders), the values without one."""
    least = np.full(SEGMENTS * VALUES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _XOR) * _ODD).min(0))
    part = least.reshape(SEGMENTS, VALUES) * _FOLD
    keys = ((part.sum(1, keepdims=True, dtype=np.uint64) - part) ^ _NAME) * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ (keys >> np.uint64(32))).ravel()


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, node (the text's set of shingles), n (how many), keys, hashes (32 bits of each) of each row, as a written table."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingle_hashes(t, words) for t in part.column("text").to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found], dtype=np.uint64).view(np.int64)
                keys = pa.array([variants(f).view(np.int64) if len(f) else [] for f in found], pa.list_(pa.int64()))
                hashes = pa.array([np.unique((f >> np.uint64(32)).astype(np.uint32).view(np.int32)) for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(node), pa.array([len(h) for h in hashes], pa.int32()), keys, hashes], names=["doc_id", "text_hash", "node", "n", "keys", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return written(rows.mapInArrow(run, "doc_id long, text_hash long, node long, n int, keys array<long>, hashes array<int>"))


def linked_in_block(part: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links of the texts (node, component, hashes) of one block or two (side 0, or 0 and 1) whose Jaccard similarity is reached:
    as many as join what is to be joined, not all pairs."""
    part = part.sort_values(["side", "node"])
    lists, side, nodes = part["hashes"].to_list(), part["side"].to_numpy(), part["node"].to_numpy()
    sizes = np.array([len(x) for x in lists])
    _, place, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(lists)), sizes), often[place] > 1
    column, both = (np.cumsum(often > 1) - 1)[place[shared]], np.zeros((len(lists), len(lists)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[shared][order]
    for first in range(0, int((often > 1).sum()), 4096):  # some shingles at a time
        low, high = np.searchsorted(column, [first, first + 4096])
        holds = np.zeros((len(lists), min(4096, int(column[high - 1]) - first + 1)), dtype=np.float32)
        holds[owner[low:high], column[low:high] - first] = 1
        both += holds @ holds.T
    near = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    if side.any():
        near &= side[:, None] != side[None, :]
    top = dict(enumerate(part["component"].to_list()))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        x, y = root(top[a]), root(top[b])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(nodes[a]), int(nodes[b])))
    return out


def similar(rows: DataFrame, similarity: float = 0.8, block: int = BLOCK, rounds: int = ROUNDS, rest: int = REST) -> DataFrame:
    """Links a, b between nodes of rows (as _signed gives them): enough of them to join all nodes that a chain of pairs joins
    that share a key and have a Jaccard similarity of `similarity` at least.

    First every node is compared with one other: of the least nodes of its keys that with which it shares most. Then come rounds of stars: in each key whose
    nodes aren't all joined yet, those outside of its largest part are compared with one node of that part, another one in each round; of a group of
    near copies each round leaves a fraction. What is still apart in a key is compared in full, part against part, in blocks of `block`.
    Rounds end when no more than `rest` nodes (of each key) are apart: each round is many stages, which the driver's memory pays for, and the blocks of so few rows are little work.
    No parameter changes which nodes are joined: two nodes of a key that are left uncompared are joined already.
    """
    keyed = cut(rows.select("node", "n", F.explode("keys").alias("key")).distinct())
    least = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("number")).where("number > 1").select("key", "least")
    near_size = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y)

    def best(pairs: DataFrame, few: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
        """node, other: of the others of a node that with which it shares most keys."""
        shared = few(pairs.groupBy("node", "other").agg(F.count("*").alias("shared")))
        return cut(few(shared.groupBy("node").agg(F.max(F.struct("shared", "other")).alias("best")).select("node", "best.other")))

    def texts(nodes: DataFrame) -> DataFrame:
        """The hashes of these nodes, once each; nodes that are few enough go to where the hashes are read, so that no others are shuffled."""
        nodes = cut(nodes)
        nodes = F.broadcast(nodes) if nodes.count() <= FEW else nodes
        return rows.select("node", "hashes").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))

    def compared(pairs: DataFrame, held: DataFrame, few: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
        """a, b of the pairs (node, other) that are similar."""
        x, y = held.toDF("node", "x"), held.toDF("other", "y")
        met = pairs.join(x, "node").join(y, "other").withColumn("both", F.size(F.array_intersect("x", "y")))
        return cut(few(met).where(F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both")) - 1e-6).select(F.col("node").alias("a"), F.col("other").alias("b")))

    stars = best(keyed.join(least, "key").where("node <> least.node").where(near_size(F.col("n"), F.col("least.n"))).select("node", F.col("least.node").alias("other")))
    found = compared(stars, written(texts(stars.select("node").union(stars.select("other")).distinct())))
    # Parts: nodes with one label are joined by links. A link leads to a smaller node, so pointers are followed down, doubled twice.
    labels = found.select(F.col("a").alias("node"), F.col("b").alias("part"))
    for _ in range(2):
        further = labels.select(F.col("node").alias("part"), F.col("part").alias("lower"))
        labels = cut(labels.join(further, "part", "left").select("node", F.coalesce("lower", "part").alias("part")))

    def apart(named: DataFrame, few: Callable[[DataFrame], DataFrame] = lambda frame: frame, side: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
        """key, node, n, part, main, of the keys that have nodes of several parts; main: the largest of them."""
        counted = few(named.groupBy("key", "part").agg(F.count("*").alias("size")))
        mains = counted.groupBy("key").agg(F.max(F.struct("size", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("main.part").alias("main"))
        return cut(few(named.select("key", "node", "n", "part").join(side(mains), "key")))

    left = apart(keyed.join(labels, "node", "left").select("key", "node", "n", F.coalesce("part", "node").alias("part")))
    if not (size := left.count()):
        return found
    held = written(texts(left.select("node").distinct()))
    for number in range(rounds):
        if size <= rest:
            break
        few, side = lambda frame: compact(frame, size), lambda frame: merging(frame, size)  # noqa: B023, E731
        left = few(left)
        inside, outside = left.where("part = main"), left.where("part <> main")
        middle = inside.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(number)).alias("h"), F.col("node").alias("other"), F.col("n").alias("m"))).alias("x")).select("key", "x.other", "x.m")
        pairs = best(few(outside.join(side(middle), "key").where(near_size(F.col("n"), F.col("m"))).select("node", "other")), few)
        new = few(compared(F.broadcast(pairs) if size <= PAIRS else pairs, held, few))
        found = found.union(new)
        # each part takes the least label that it was linked to
        part_of = few(left.select("node", "part").distinct())
        ends = few(new.join(side(part_of.toDF("a", "p")), "a")).join(side(part_of.toDF("b", "q")), "b").select("p", "q")
        lower = few(ends.union(ends.select("q", "p")).toDF("part", "q")).groupBy("part").agg(F.min("q").alias("lower")).where("lower < part")
        left = apart(few(left.drop("main").join(side(lower), "part", "left")).select("key", "node", "n", F.coalesce("lower", "part").alias("part")), few, side)
        if not (size := left.count()):
            return found
    # Part against part: blocks of the largest part (kind 0) meet blocks of all the rest (kind 1), and these each other.
    kind = F.when(F.col("part") == F.col("main"), 0).otherwise(1).alias("kind")
    groups = left.select("key", "node", "part", kind)
    parts = groups.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.count_if(F.col("kind") == 0) / block)).cast("int").alias("mains"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("kind") == 1) / block)).cast("int").alias("rests"))
    dealt = groups.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("kind") == 0, F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    cell = lambda first, second, side: F.struct(first.alias("i"), second.alias("j"), side.alias("side"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    of_main = F.transform(every(F.col("rests")), lambda o: cell(-1 - F.col("own"), o, F.lit(0)))
    of_rest = F.concat(F.transform(every(F.col("mains")), lambda o: cell(-1 - o, F.col("own"), F.lit(1))), F.transform(every(F.col("rests")), lambda o: cell(F.least("own", o), F.greatest("own", o), (F.col("own") > o).cast("int"))))
    sent = dealt.select("key", "node", F.col("part").alias("component"), F.explode(F.when(F.col("kind") == 0, of_main).otherwise(of_rest)).alias("p")).select("key", "node", "component", "p.*")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(linked_in_block(part, similarity), columns=["a", "b"])

    return found.union(sent.join(held, "node").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long"))


def _kept(docs: DataFrame, rows: DataFrame, joined: DataFrame) -> DataFrame:
    """docs with one row of each component of rows' nodes: that of its smallest doc_id (null where it has no other), of several
    that with the least text hash. Texts are not grouped: the kept keys are, and they meet docs once."""
    least = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least"))
    best = least.join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    own, text = fresh(docs, "kept_id"), fresh(docs, "kept_hash")
    keys = cut(best.select(F.col("least.doc_id").alias(own), F.col("least.text_hash").alias(text)))
    is_kept = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text))
    met = docs.join(keys, is_kept, "left_semi")
    same = rows.join(keys, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col("text_hash") == F.col(text)), "left_semi")
    twice = cut(same.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(text)).count().where("count > 1").drop("count"))
    if twice.isEmpty():
        return met
    number = fresh(docs, "kept_number")
    once = Window.partitionBy(F.col("doc_id").cast("long"), F.xxhash64("text")).orderBy(F.lit(0))
    some = met.join(twice, is_kept, "left_semi").withColumn(number, F.row_number().over(once)).where(F.col(number) == 1).select(*docs.columns)
    return met.join(twice, is_kept, "left_anti").union(some)


def without_near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """docs with one row of each component of fingerprints. Columns stay as they are."""
    rows = cut(fingerprints(docs, words)).withColumnRenamed("fp", "node")
    return _kept(docs, rows, components(links(rows.select(F.col("node").alias("fp")).distinct(), bits)))


def without_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of texts that a chain of Jaccard similarities (of their sets of word shingles) of
    `similarity` at least joins. Null, empty and wordless texts are one group. Columns stay as they are.

    Three differing bits of a SimHash stand for a similarity near one; at 0.8 about ten of 64 differ, which two
    segments can't hold. So a signature has least hashes in place of bits. It is cut into few segments, and each is
    indexed by its variants with one value deleted: two texts meet where a segment differs in one value at most. At a
    similarity of 0.8 that is so for a segment in 0.655 of cases, for one of the five in 0.995. What meets is verified
    by the sets of 32-bit hashes of all shingles.
    """
    rows = _signed(docs, words)
    return _kept(docs, rows, components(similar(rows, similarity)))
