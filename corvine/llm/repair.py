"""Conversation structure repair by signatures.

A conversation's rows become one string, its signature: a letter for each row that says what its role begins
with and whether it is at fault. What a cheapest repair does depends on this string alone, so each distinct
signature is solved once, by a recursion over its halves that is memoised over all signatures of a task; the audits
(one letter an edit) are joined back and replayed on the rows.

A repair is a walk over four states: nothing said yet, a system message said, the assistant's turn, the user's turn.
A signature's solution says of every two states the cheapest way from one to the other and, among equally cheap ones, the
ASCII-least audit. Inserts belong to the row behind them, so an audit of n rows never is the beginning of another
one, and solutions can be composed: halves of a signature, and the parts of a long conversation.

Rows are dealt by ranges of (conversation, turn, role, text) and numbered there. A part is what a conversation has in a block of
PART numbers: most conversations are one or two parts, one that holds a third of all rows is many, in many tasks. Where it
comes together it is a few numbers a part, and at the end the text that its digest needs, streamed part by part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import cut, written

PART = 1024
#: States of a repair: nothing, a system message, a user's message, an answer said last.
NONE, SYSTEM, USER, ANSWER = range(4)
#: Where a message leads to by the first letter of its role. A rerole or an insert gives the one role out of user and assistant that fits.
_NEXT = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ANSWER): USER, ("a", USER): ANSWER}
_GIVEN = {NONE: USER, SYSTEM: USER, USER: ANSWER, ANSWER: USER}
_NAMES = {USER: "user", ANSWER: "assistant"}
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: Of each last state: the cost and the inserts that end a conversation.
_END = {NONE: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ANSWER: (0, "")}
Solution = dict[tuple[int, int], tuple[int, str]]


@lru_cache(maxsize=200_000)
def solved(signature: str) -> Solution:
    """(state before, state after) -> (cost, audit): the cheapest repair of the rows of a signature, of equally cheap ones the ASCII-least.

    Letters: s u a for a role of system, user, assistant, x for another; capital if the row is truncated; d if it must go.
    """
    if len(signature) > 1:
        half = 1 << ((len(signature) - 1).bit_length() - 1)
        first, second = solved(signature[:half]), solved(signature[half:])
        ways: Solution = {}
        for (a, b), (cost, audit) in first.items():
            for c in range(4):
                if (b, c) in second:
                    more, rest = second[b, c]
                    if (a, c) not in ways or (cost + more, audit + rest) < ways[a, c]:
                        ways[a, c] = (cost + more, audit + rest)
        return ways
    ways = {}

    def offer(a: int, b: int, cost: int, audit: str) -> None:
        if (a, b) not in ways or (cost, audit) < ways[a, b]:
            ways[a, b] = (cost, audit)

    worse = TRUNCATED if signature.isupper() else 0
    for start in range(4):
        state = start
        for inserts in range(3):
            cost, marks = INSERT * inserts, "I" * inserts
            offer(start, state, cost + DELETE, marks + "D")
            if signature != "d":
                if (kept := _NEXT.get((signature.lower(), state))) is not None:
                    offer(start, kept, cost + worse, marks + "K")
                offer(start, _GIVEN[state], cost + worse + REROLE, marks + "R")
            state = _GIVEN[state]
    return ways


def chosen(parts: list[list[dict]]) -> tuple[int, list[int], str]:
    """The cost, the state after each part, and the last inserts of a conversation. A part is a list of ways: before, after, cost, place (of
    the way's audit among those with one state before it, in ASCII order)."""
    far = float("inf")
    left = [{s: cost for s, (cost, _) in _END.items()}]
    for ways in reversed(parts):
        best = dict.fromkeys(range(4), far)
        for w in ways:
            best[w["before"]] = min(best[w["before"]], w["cost"] + left[-1][w["after"]])
        left.append(best)
    left.reverse()
    state, states = NONE, []
    for ways, rest, here in zip(parts, left[1:], left, strict=False):
        state = min((w["place"], w["after"]) for w in ways if w["before"] == state and w["cost"] + rest[w["after"]] == here[state])[1]
        states.append(state)
    return int(left[0][NONE]), states, _END[state][1]


def replayed(state: int, audit: str, rows: list[dict]) -> tuple[list[dict], int]:
    """The rows (turn, role, text) that an audit makes of the given ones, with edit, and the state behind them. Inserted rows have no turn and
    an empty text."""
    out, source = [], iter(rows)
    for edit in audit:
        row = {"turn": None, "role": None, "text": ""} if edit == "I" else next(source)
        if edit == "D":
            continue
        if edit == "K":
            state = _NEXT[row["role"][:1], state]
            out.append({"edit": edit, **row})
        else:
            state = _GIVEN[state]
            out.append({"edit": edit, **row, "role": _NAMES[state]})
    return out, state


def damaged(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of messages that are damaged by crc32(conv_id:turn) % 20: 0 is dropped, 1 loses its text, 2 its full stops,
    exclamation and question marks, 3 comes twice, 4 becomes the user's. Null roles and texts are one blank, as are nulls in the checksum."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = messages.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("n")).drop("n")


def ordered(messages: DataFrame) -> DataFrame:
    """conv_id, pos, turn, role, text, initial, blank, ended, h as a written table. pos grows in the order of conversation, turn, role, text, nulls
    first; texts with the same first 64 characters are in the order of a hash. Null roles and texts are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    # the last key parts rows that are equal in all else
    keys = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), F.col("copy")]
    ranged = rows.withColumn("copy", F.monotonically_increasing_id() % 64).repartitionByRange(*keys).sortWithinPartitions(*keys)
    last = F.right(F.btrim("text", F.lit(" \t\n\v\f\r")), F.lit(1))
    initial = F.substring("role", 1, 1)
    return written(ranged.select(
        "conv_id", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), (last == "").alias("blank"), last.isin(".", "!", "?").alias("ended"), F.xxhash64("role", "text").alias("h"),
    ))


def _same(*names: str) -> Column:
    """Null-safe equality of columns and those of the same names behind an underscore."""
    return reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])


def parts(rows: DataFrame) -> DataFrame:
    """conv_id, part, signature, initials, turns (lowest, highest, number of distinct ones), blank, duplicate, truncated of the parts of
    conversations; rows as `ordered` gives them. A row's first fault counts, in this order."""
    firsts = rows.where("NOT blank").groupBy("conv_id", "h").agg(F.min("pos").alias("_pos")).select("_pos")
    met = rows.select("conv_id", "pos", "turn", "initial", "blank", "ended").join(firsts, F.col("pos") == F.col("_pos"), "left")
    fault = F.when(F.col("blank"), "b").when(F.col("_pos").isNull(), "d").when(~F.col("ended"), "t").otherwise("")
    letter = F.when(fault.isin("b", "d"), "d").when(fault == "t", F.upper("initial")).otherwise(F.col("initial"))
    told = met.select("conv_id", "pos", F.shiftright("pos", PART.bit_length() - 1).alias("part"), "turn", "initial", fault.alias("fault"), letter.alias("letter"))
    held = told.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", "letter", "initial"))).alias("r"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"),
        *[F.count_if(F.col("fault") == mark).alias(name) for mark, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
    )
    joined = lambda c: F.array_join(F.transform("r", lambda x: x[c]), "").alias("signature" if c == "letter" else "initials")
    return held.select("conv_id", "part", joined("letter"), joined("initial"), "low", "high", "turns", "blank", "duplicate", "truncated")


_WAYS = pa.list_(pa.struct([("before", pa.int8()), ("after", pa.int8()), ("cost", pa.int64()), ("place", pa.int8()), ("audit", pa.string())]))


def solutions(signatures: DataFrame) -> DataFrame:
    """signature, ways (before, after, cost, place, audit) of each distinct signature."""

    def ways(signature: str) -> list[dict]:
        found = sorted((a, audit, b, cost) for (a, b), (cost, audit) in solved(signature).items())
        return [{"before": a, "after": b, "cost": cost, "place": sum(x[0] == a for x in found[:i]), "audit": audit} for i, (a, audit, b, cost) in enumerate(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                names = batch.column(0).slice(at, 512)
                yield pa.RecordBatch.from_arrays([names, pa.array([ways(s) for s in names.to_pylist()], _WAYS)], names=["signature", "ways"])

    return signatures.select("signature").distinct().mapInArrow(run, "signature string, ways array<struct<before:tinyint,after:tinyint,cost:bigint,place:tinyint,audit:string>>")


def audits(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the parts of conversations: conv_id, cost, audit, n_parts, … of each conversation, and conv_id, part, before, audit, last of each part."""
    known = written(solutions(found))
    found = found.withColumn("prefix", F.left("initials", F.lit(1))).withColumn("suffix", F.right("initials", F.lit(1)))
    costs = known.select(F.col("signature").alias("_signature"), F.transform("ways", lambda w: F.struct(*[w[c].alias(c) for c in ("before", "after", "cost", "place")])).alias("ways"))
    met = found.join(costs, F.col("signature") == F.col("_signature"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials") - 1), lambda i: F.substring("initials", i, F.lit(2)))
    inner = F.when(F.length("initials") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    brief = F.struct("part", "signature", "ways", "prefix", "suffix", inner.alias("illegal"), "low", "high", "turns")
    whole = met.groupBy("conv_id").agg(F.array_sort(F.collect_list(brief)).alias("p"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    path = "cost bigint, states array<tinyint>, last string"

    @F.udf(path, useArrow=True)
    def walk(ways: list) -> tuple:
        return chosen(ways)

    before = lambda i: F.get("p", i - 1)
    seams = F.aggregate(F.transform("p", lambda x, i: F.when((i > 0) & ~F.concat(before(i)["suffix"], x["prefix"]).isin("su", "ua", "au"), 1).otherwise(0) + x["illegal"]), F.lit(0).cast("long"), lambda s, x: s + x)
    # turns rise from part to part: one that two parts share is the highest of the first and the lowest of the second
    shared = F.aggregate(F.transform("p", lambda x, i: x["turns"] - F.when((i > 0) & (before(i)["high"] == x["low"]), 1).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)
    spans = F.coalesce(F.array_max(F.transform("p", lambda x: x["high"])) - F.array_min(F.transform("p", lambda x: x["low"])) + 1 - shared, F.lit(0).cast("long"))
    walked = cut(whole.select("conv_id", "blank", "duplicate", "truncated", seams.alias("illegal"), spans.alias("gaps"), F.transform("p", lambda x: F.struct(x["part"].alias("part"), x["signature"].alias("signature"))).alias("p"), walk(F.transform("p", lambda x: x["ways"])).alias("w")))
    steps = walked.select("conv_id", F.size("p").alias("n_parts"), F.posexplode(F.arrays_zip("p", F.col("w.states").alias("after"))).alias("i", "x"), F.col("w.states").alias("s"), F.col("w.last").alias("l"))
    steps = steps.select("conv_id", "n_parts", F.col("x.p.part").alias("part"), F.col("x.p.signature").alias("signature"), F.when(F.col("i") == 0, F.lit(NONE)).otherwise(F.get("s", F.col("i") - 1)).cast("byte").alias("before"), F.col("x.after").alias("after"), F.when(F.col("i") == F.col("n_parts") - 1, F.col("l")).otherwise("").alias("last"))
    ways = known.select(F.col("signature").alias("_signature"), F.explode("ways").alias("y")).select("_signature", F.col("y.before").alias("_before"), F.col("y.after").alias("_after"), F.col("y.audit").alias("audit"))
    of_parts = steps.join(ways, (F.col("signature") == F.col("_signature")) & (F.col("before") == F.col("_before")) & (F.col("after") == F.col("_after"))).select("conv_id", "part", "n_parts", "before", F.concat("audit", "last").alias("audit"))
    of_parts = cut(of_parts)
    texts = of_parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    conversations = walked.select(F.col("conv_id").alias("_conv_id"), "blank", "duplicate", "truncated", "illegal", "gaps", F.col("w.cost").alias("cost")).join(texts, _same("conv_id")).drop("_conv_id")
    return conversations, of_parts


_ROWS = "array<struct<edit:string,turn:bigint,role:string,text:string>>"


def repaired_parts(rows: DataFrame, of_parts: DataFrame) -> DataFrame:
    """conv_id, part, n_parts, rows (edit, turn, role, text) of the parts' repaired rows."""
    held = rows.groupBy("conv_id", F.shiftright("pos", PART.bit_length() - 1).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "role", "text"))).alias("r"))
    held = held.select("conv_id", "part", F.transform("r", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"))).alias("r"))
    told = of_parts.select(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), "n_parts", "before", "audit")

    @F.udf(_ROWS, useArrow=True)
    def replay(before: int, audit: str, given: list) -> list:
        return replayed(before, audit, [row.asDict() for row in given])[0]

    return held.join(told, _same("conv_id", "part")).select("conv_id", "part", "n_parts", replay("before", "audit", "r").alias("rows"))


def repaired(messages: DataFrame) -> DataFrame:
    """conv_id, part, place (from 0 within the part), edit (K kept, R with another role, I inserted), turn, role, text: the messages of all
    conversations after their cheapest repairs, in the order of part and place. See audited for what a repair is."""
    rows = ordered(messages)
    _, of_parts = audits(cut(parts(rows)))
    return repaired_parts(rows, of_parts).select("conv_id", "part", F.posexplode("rows").alias("place", "r")).select("conv_id", "part", "place", "r.*")


def _digests(of_parts: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the parts' repaired rows. Conversations of one part are hashed where they are; the parts of the others are
    streamed in order past one hash at a time."""
    said = of_parts.select("conv_id", "part", "n_parts", F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n").alias("content"), (F.size("rows") > 0).alias("any"))
    said = written(said.select("conv_id", "part", "n_parts", "any", F.when(F.col("n_parts") == 1, F.sha2("content", 256)).alias("sha"), F.when(F.col("n_parts") > 1, F.col("content")).alias("content")))
    kind = dict(of_parts.dtypes)["conv_id"]
    several = said.where("n_parts > 1 AND any").select("conv_id", "part", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, first = None, None, True

        def shut() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([now, pa.array([running.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            ids = batch.column("conv_id")
            for i, content in enumerate(batch.column("content")):
                one = ids.slice(i, 1)
                if running is None or not one.equals(now):
                    if running is not None:
                        yield shut()
                    now, running, first = one, hashlib.sha256(), True
                running.update(b"" if first else b"\n")
                running.update(content.as_py().encode("utf-8", "surrogatepass"))
                first = False
        if running is not None:
            yield shut()

    streamed = several.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
    return said.where("n_parts = 1").select("conv_id", F.col("sha").alias("repaired_sha256")).union(streamed)


def audited(messages: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    Rows are taken by turn, nulls first, then by role and text. A row's first fault counts: blank (nothing but white space), duplicate (its role and text
    came earlier; told by a 64-bit hash), truncated (its last other character isn't . ! or ?). illegal: neighbours whose roles' first letters aren't su, ua or
    au. gaps: turns missing between the lowest and the highest. Edits: keep 0, rerole to user or assistant 1, delete 2 (required for
    blank and duplicate rows), insert an empty message of user or assistant 5; a truncated row that stays adds 5. audit: initials of the cheapest edits that
    give roles beginning with (s?(ua)+)?, of equally cheap ones the ASCII-least. repaired_sha256: the repaired `role:text`, joined by line feeds.

    of: the messages whose conversations are to be reported (default: messages); one without rows has zeros, an empty audit and the hash of
    nothing. A null conv_id is a conversation, repeated rows are duplicates, other columns are not read, an empty table gives an empty result. audit and
    the repaired text's digest are one value a conversation, so a conversation has at most 2³¹ rows.
    """
    rows = ordered(messages)
    conversations, of_parts = audits(cut(parts(rows)))
    hashes = _digests(repaired_parts(rows, of_parts)).withColumnRenamed("conv_id", "_conv_id")
    met = conversations.join(hashes, _same("conv_id"), "left").drop("_conv_id").withColumnRenamed("conv_id", "_conv_id")
    all_ids = (messages if of is None else of).select("conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_ids.join(met, _same("conv_id"), "left").select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
