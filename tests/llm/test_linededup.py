import hashlib
import random

from corvine.llm import linededup


def brute(rows, min_chars=20, min_docs=3):
    strip = " \t\n\v\f\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(doc)
    keeper = {k: max(d for d in docs if d is not None) for k, docs in held.items() if len(docs) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(spark):
    long = "A line that is surely long enough é"
    rows = [(1, long + "\nshort\n" + long), (2, "  " + long.upper().replace("É", "é") + "\t"), (3, f"{long}\n\n{long}\nunique line that stays where it is"), (3, f"{long}\n\n{long}\nunique line that stays where it is"), (3, "another text\n" + long), (None, long), (None, None), (7, None), (8, ""), (9, "\n\n"), (10, "short"), (11, " " * 30 + "x"), (12, "x" * 19), (13, "x" * 19), (14, "x" * 19)]
    docs = spark.createDataFrame([(*r, "n", 5) for r in rows], "doc_id long, text string, runs string, h int")
    got = sorted([tuple(r)[:4] for r in linededup.digest(docs).collect()], key=str)
    assert got == brute(rows)
    assert linededup.digest(docs.limit(0)).count() == 0


def test_random(spark):
    r = random.Random(3)
    pool = [f"line number {i} of the common pool" for i in range(30)]
    rows = [(i, "\n".join(r.choice([*pool, f"own line {r.random()} of it", "x"]) for _ in range(r.randrange(0, 40)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(x)[:4] for x in linededup.digest(docs).collect()], key=str) == brute(rows)


def test_text_and_columns(spark):
    line = "the same long line in all of these"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", "en") for i in range(4)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got == {0: "own 0", 1: "own 1", 2: "own 2", 3: f"{line}\nown 3"}
