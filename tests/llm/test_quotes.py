from corvine.llm import quotes


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "How do I cut a tree?\nIt is an oak.\n\nAny saw will do?"),
        (1, 1, "assistant", "Use a long saw.\nMind the wind."),
        (1, 2, "user", "Am Montag, dem 3., schrieb Anna:\n> How  do I CUT a tree?\n> It is an oak.\n\nI had the same question."),
        (1, 3, "assistant", "On Monday Bob wrote:\n> > Any saw will do?\n> Use a long saw.\nNo, a chain saw.\n"),
        (1, 4, "user", "> never said by anyone\nwhat?"),
        (2, 0, "user", "> Use a long saw.\nother conversation"),
    ]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(messages).collect()}
    assert [got[1, t].reply_to for t in range(5)] == [None, 0, 0, 1, 3]
    assert [got[1, t].depth for t in range(5)] == [0, 1, 1, 2, 3]
    assert got[1, 2].own_text == "I had the same question." and got[1, 3].own_text == "No, a chain saw."
    assert (got[1, 2].n_quoted, got[1, 2].max_level, got[1, 2].n_linked) == (2, 1, 3)  # two lines and their passage
    assert (got[1, 3].n_quoted, got[1, 3].max_level, got[1, 3].n_linked, got[1, 3].linked_level) == (2, 2, 2, 1)
    assert got[1, 4].n_linked == 0 and got[2, 0].reply_to is None
    assert all(r.reply_to is None or r.reply_to < r.turn for r in got.values())


def test_deeper_levels_and_latest_source(spark, monkeypatch):
    """A message with quotes of level 2 only; a passage said twice is the latest earlier message's, over blocks of places, too."""
    monkeypatch.setattr(quotes, "PLACES", 3)
    rows = [
        (1, 0, "u", "the first thing said"),
        (1, 1, "u", "something else"),
        (1, 2, "u", "the first thing said"),
        (1, 3, "u", "> > something else\n\nonly level two"),
        (1, 4, "u", "> the first thing said\nof turn two"),
        *[(1, t, "u", f"filler {t}") for t in range(5, 12)],
        (1, 12, "u", "> the first thing said\n> > something else\n> filler 9\nlate"),
        (1, 13, "u", "the first thing said\n> the first thing said"),
    ]
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[3].reply_to, got[3].linked_level, got[3].n_linked) == (1, 2, 1)
    assert got[4].reply_to == 2
    assert (got[12].reply_to, got[12].n_linked) == (2, 3)  # more characters than of turn 9
    assert got[13].reply_to == 2 and got[13].own_text == "the first thing said"
    assert got[12].depth == got[2].depth + 1


def plain(rows):
    """Parents and links in plain Python, of rows (turn, text) of one conversation in order."""
    import re

    prefix = re.compile(r"^(?:[ \t]*>)+")
    own, out = {}, []
    for place, (_, text) in enumerate(rows, 1):
        found, run, last = set(), [], None
        for line in [*(text or "").split("\n"), None]:
            mark = prefix.match(line or "")
            level = mark.group().count(">") if mark else 0
            words = " ".join(prefix.sub("", line or "").lower().split())
            if (not words or level != last) and run:
                found.add((last, " ".join(run)))
                run = []
            if words:
                found.add((level, words))
                run.append(words)
                last = level
        links = [(lv, w, own[w]) for lv, w in found if lv and w in own]
        best = {}
        for lv, w, source in links:
            best[lv, source] = best.get((lv, source), 0) + len(w)
        pick = max(best, key=lambda k: (-k[0], best[k], k[1])) if best else None
        out.append((pick[1] if pick else place - 1 or None, len(links)))
        for lv, w in found:
            if not lv:
                own[w] = place
    return out


def test_against_plain_version(spark):
    import random

    r = random.Random(3)
    said = [f"sentence number {n} of a talk" for n in range(12)]
    rows = []
    for conv in range(8):
        for turn in range(40):
            lines = [("> " * r.choice([0, 0, 0, 1, 1, 2, 3])) + r.choice([*said, ""]) for _ in range(r.randrange(1, 7))]
            rows.append((conv, turn, "u", "\n".join(lines)))
    got = {(x.conv_id, x.place): x for x in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in range(8):
        for place, (parent, n_linked) in enumerate(plain([(t, text) for c, t, _, text in rows if c == conv]), 1):
            x = got[conv, place]
            assert (x.reply_to, x.n_linked) == (None if parent is None else parent - 1, n_linked), (conv, place)
            assert x.depth == (0 if parent is None else got[conv, parent].depth + 1)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "user", "> a"), (3, None, None, None), (3, 5, "user", ""), (3, 5, "user", ""), (3, 2000, "user", "far"), (4, 1, "user", "> \n>\n" * 3000), (5, 0, "u", "same"), (5, 1, "u", "same"), (5, 2, "u", "> same")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.conversations(messages).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.place): r for r in got}
    assert by[None, 2].reply_to == 1 and by[None, 2].n_linked == 1
    assert [by[3, p].reply_to for p in (1, 2, 3, 4)] == [None, None, 5, 5] and by[3, 1].own_text is None
    assert by[4, 1].n_quoted == 6000 and by[5, 3].reply_to == 1  # the latest that said it
    assert quotes.conversations(messages.limit(0)).count() == 0
