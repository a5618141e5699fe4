"""Conversation repair against every possible repair of short conversations, and against a plain program."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corvine.llm import repair

ROLES = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}


def every_repair(signature):
    """The cheapest edits of all there are, with up to two inserts at each place."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    edits = [("K", None, 0), ("D", "", 2), ("R", "u", 1), ("R", "a", 1)]
    for inserts in itertools.product(gaps, repeat=len(signature) + 1):
        for done in itertools.product(edits, repeat=len(signature)):
            cost, audit, roles = 5 * len("".join(inserts)), "I" * len(inserts[0]), inserts[0]
            for letter, (mark, role, price), more in zip(signature, done, inserts[1:], strict=True):
                if letter == "d" and mark != "D":
                    break
                cost += price + (5 if letter.isupper() and mark != "D" else 0)
                audit += mark + "I" * len(more)
                roles += (letter.lower() if role is None else role) + more
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


@pytest.mark.parametrize("length", [0, 1, 2])
def test_every_short_signature(length):
    for letters in itertools.product("suaxSUAXd", repeat=length):
        signature = "".join(letters)
        assert plain_walk(signature) == every_repair(signature), signature


def plain_walk(signature):
    """Backwards over the rows, one at a time."""
    after = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    give = {0: 2, 1: 2, 2: 3, 3: 2}
    for letter in reversed(signature):
        here = {}
        for q in range(4):
            more = 5 if letter.isupper() else 0
            ways = [(after[q][0] + 2, "D" + after[q][1])]
            if letter != "d":
                ways.append((after[give[q]][0] + 1 + more, "R" + after[give[q]][1]))
                if (letter.lower(), q) in keep:
                    to = after[keep[letter.lower(), q]]
                    ways.append((to[0] + more, "K" + to[1]))
            here[q] = min(ways)
        for _ in range(3):
            here = {q: min(w, (here[give[q]][0] + 5, "I" + here[give[q]][1])) for q, w in here.items()}
        after = here
    return after[0]


def whole(signature, size):
    """The repair of a signature by its parts of a given size."""
    cut = [signature[i : i + size] for i in range(0, len(signature), size)]
    parts = []
    for part in cut:
        found = sorted((a, audit, b, cost) for (a, b), (cost, audit) in repair.solved(part).items())
        parts.append([{"before": a, "after": b, "cost": cost, "place": i, "audit": audit} for i, (a, audit, b, cost) in enumerate(found)])
    cost, states, last = repair.chosen(parts)
    audit, state = "", 0
    for ways, after in zip(parts, states, strict=True):
        audit += next(w["audit"] for w in ways if (w["before"], w["after"]) == (state, after))
        state = after
    return cost, audit + last


def test_parts_and_halves():
    r = random.Random(5)
    for _ in range(1500):
        signature = "".join(r.choice("suaxSUAXdua") for _ in range(r.randrange(0, 40)))
        assert whole(signature, r.choice([1, 2, 3, 7, 100])) == plain_walk(signature), signature


def brute(rows):
    """conv_id -> the digest, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c == conv:
                role, text = " " if role is None else role, " " if text is None else text
                d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
                text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
                own += [(turn is not None, turn, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1)
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [x[2][:1] if x[2][:1] in ("s", "u", "a") else "x" for x in own]
        letters = "".join("d" if f in ("b", "d") else i.upper() if f == "t" else i for i, f in zip(initials, faults, strict=True))
        cost, audit = plain_walk(letters)
        turns = [x[1] for x in own if x[1] is not None]
        said, source, wanted = [], iter(own), None
        for mark in audit:
            row = None if mark == "I" else next(source)
            if mark == "D":
                continue
            role = row[2] if mark == "K" else (wanted or "user")
            wanted = "assistant" if role[0] == "u" else "user"
            said.append(f"{role}:{row[3] if row else ''}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def some(r, convs, most):
    texts = ["Yes.", "No!", "why?", "and then", "", " \t", "é…", "A longer one.\nWith lines?  ", None]
    rows = []
    for conv in convs:
        for turn in range(r.randrange(0, most)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 2, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts) if r.random() < 0.5 else f"words {r.random()}" + r.choice(["", ".", "? "])))
    return rows


def test_against_plain_program(spark, monkeypatch):
    r = random.Random(8)
    rows = some(r, [*range(60), None], 12)
    rows += rows[:20]
    docs = spark.createDataFrame([(*x, "n", 1) for x in rows], "conv_id long, turn long, role string, text string, part string, pos int")
    for size in (1024, 4):  # one part a conversation, and many
        monkeypatch.setattr(repair, "PART", size)
        got = {x.conv_id: tuple(x)[1:] for x in repair.audited(repair.damaged(docs), docs).collect()}
        assert got == brute(rows)


def test_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert repair.audited(spark.createDataFrame([], schema)).count() == 0
    lone = spark.createDataFrame([("é", None, None, None)], schema)
    assert [tuple(x) for x in repair.audited(lone).collect()] == [("é", 0, 1, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest())]
    long = spark.createDataFrame([("a", 1, "user", "x" * 300_000 + "."), ("a", 2, "assistant", "y" * 300_000 + ".")], schema)
    assert repair.audited(long).first().audit == "KK"


def test_long_conversation_is_many_parts(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART", 64)
    r = random.Random(2)
    rows = [(1, i, r.choice(["user", "assistant"]), f"turn {i}" + r.choice(["", ".", "."])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.audited(repair.damaged(docs), docs).first()
    assert tuple(got)[1:] == brute(rows)[1]
    assert repair.parts(repair.ordered(docs)).count() >= 3000 // 64


def test_repaired_rows(spark):
    docs = spark.createDataFrame([(1, 1, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 3, "user", "Ho"), (1, 4, "user", "Ha.")], "conv_id long, turn long, role string, text string")
    got = [(x.edit, x.turn, x.role, x.text) for x in repair.repaired(docs).orderBy("part", "place").collect()]
    assert got == [("R", 1, "user", "Hi."), ("R", 4, "assistant", "Ha.")]
