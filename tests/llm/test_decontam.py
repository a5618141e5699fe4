import random

from corvine.llm import decontam


def edit(a, b):
    """Least edit distance of the words a to any part of the words b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def garble(r, tokens, n, pool):
    tokens = list(tokens)
    for _ in range(n):
        at, kind = r.randrange(len(tokens)), r.randrange(3)
        if kind == 0:
            tokens[at] = r.choice(pool)
        elif kind == 1:
            del tokens[at]
        else:
            tokens.insert(at, r.choice(pool))
    return tokens


def test_distance_is_exact():
    r = random.Random(4)
    pool = list("abcdef")
    for _ in range(300):
        item = [r.choice(pool) for _ in range(r.randrange(1, 12))]
        text = [r.choice([*pool, "zz"]) for _ in range(r.randrange(0, 20))]
        index = decontam.Index.build([(1, " ".join(item))])
        import numpy as np

        assert index.distance(0, np.array([index.vocabulary.get(w, 0) for w in text], dtype=np.int32))[0] == edit(item, text)


def test_recall_and_no_false_reports():
    r = random.Random(9)
    pool = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    draw = lambda n: r.choices(pool, weights, k=n)
    items = [(i, draw(r.randrange(15, 60))) for i in range(100)]
    index = decontam.Index.build([(i, " ".join(t)) for i, t in items])
    hit = {0: [], 1: [], 0.05: [], 0.1: []}
    for share in hit:
        for i, tokens in items:
            n = share if share in (0, 1) else max(1, int(share * len(tokens)))
            text = draw(200) + garble(r, tokens, n, pool) + draw(300)
            found = {x["item_id"]: x for x in index.leaks([" ".join(text)])[0]}
            hit[share].append(i in found)
            for x in found.values():
                own = dict(items)[x["item_id"]]
                assert x["distance"] >= edit(own, text) and x["distance"] <= 0.2 * len(own)
    recall = {s: sum(h) / len(h) for s, h in hit.items()}
    print(recall)
    assert recall[0] == 1 and recall[1] >= 0.98 and recall[0.05] >= 0.95 and recall[0.1] >= 0.95


def test_whole_limit_is_found():
    """All of 20 % spent anywhere: both ends of long items cut, edits spread over items of all lengths."""
    r = random.Random(11)
    pool = [f"w{i}" for i in range(2000)]
    items = [(i, r.choices(pool, k=n)) for i, n in enumerate([1, 4, 5, 9, 14, 15, 16, 40, 99, 100, 150, 200, 300, 500] * 3)]
    index = decontam.Index.build([(i, " ".join(t)) for i, t in items])
    hit = {"ends": [], "first": [], "spread": []}
    for i, tokens in items:
        n = int(0.2 * len(tokens))
        cut = {"ends": tokens[n // 2 : len(tokens) - (n - n // 2)], "first": tokens[n:], "spread": garble(r, tokens, n, pool)}
        texts = [r.choices(pool, k=30) + c + r.choices(pool, k=30) for c in cut.values()]
        for kind, text, found in zip(cut, texts, index.leaks([" ".join(t) for t in texts]), strict=True):
            distance = edit(tokens, text)
            assert distance <= n
            hit[kind].append([x["distance"] for x in found if x["item_id"] == i] == [distance])
    print({k: sum(h) / len(h) for k, h in hit.items()})
    assert all(map(all, hit.values()))


def test_walks_reach_the_target():
    """Walks alone, at the limit itself: edits spread over the item, all in its ends, or in its middle."""
    r = random.Random(12)
    pool = [f"w{i}" for i in range(2000)]
    recall = {}
    for m in (5, 10, 15, 40, 300, 1000):
        items = [(i, r.choices(pool, k=m)) for i in range(60 if m < 300 else 15)]
        index = decontam.Index.build([(i, " ".join(t)) for i, t in items], whole=False)
        n = int(0.2 * m)
        kinds = {
            "spread": lambda t: garble(r, t, n, pool),
            "cut": lambda t: t[n // 2 : m - (n - n // 2)],
            "ends": lambda t: garble(r, t[: m // 4], n // 2, pool) + t[m // 4 : m - m // 4] + garble(r, t[m - m // 4 :], n - n // 2, pool),
            "middle": lambda t: t[: m // 3] + garble(r, t[m // 3 : m - m // 3], n, pool) + t[m - m // 3 :],
        }
        for kind, change in kinds.items():
            texts = [" ".join(r.choices(pool, k=40) + change(t) + r.choices(pool, k=40)) for _, t in items]
            recall[m, kind] = sum(any(x["item_id"] == i for x in found) for (i, _), found in zip(items, index.leaks(texts), strict=True)) / len(items)
    print(recall)
    assert all(x >= 0.9 for x in recall.values()) and sum(recall.values()) / len(recall) >= 0.95


def test_odd_rows(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    benchmark = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, None, "x"), (None, item, "x"), (3, " .,", "x"), (4, "short one", "x")], "item_id long, text string, leaks string")
    rows = [(1, "aa " + item.upper() + " bb"), (2, item.replace("five", "5").replace(" ", "\n")), (3, None), (4, ""), (5, "a SHORT; one"), (6, "word " * 9000), (6, "word " * 9000), (None, item)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, item_id string")
    got = sorted(((x.doc_id, x.item_id, x.distance, x.start, x.end) for x in decontam.leaks(docs, benchmark).collect()), key=str)
    assert got == sorted([(1, 1, 0, 1, 17), (2, 1, 1, 0, 16), (5, 4, 0, 1, 3), (None, 1, 0, 0, 16)], key=str)
    kept = decontam.without_leaks(docs, benchmark)
    assert sorted(x.doc_id for x in kept.collect()) == [3, 4, 6, 6] and kept.columns == docs.columns
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), benchmark).count() == 0


def test_blocks_give_the_same(spark, folder):
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    parts = list(decontam.blocks(benchmark, 7))
    assert len(parts) > 5 and sorted(i for p in parts for i in p.item_ids) == sorted(r.item_id for r in benchmark.collect())
    want = sorted(decontam.leaks(docs, benchmark).collect())
    brute = {(d.doc_id, b.item_id) for d in docs.collect() for b in benchmark.collect() if f" {' '.join(decontam.words(b.text))} " in f" {' '.join(decontam.words(d.text))} "}
    assert brute and brute <= {(r.doc_id, r.item_id) for r in want}
    assert sorted(decontam.leaks(docs, benchmark, size=12).collect()) == want
    left = {r.doc_id for r in docs.collect()} - {r.doc_id for r in want}
    for size in (12, 20000):
        kept = decontam.without_leaks(docs.withColumn("leaks", docs.doc_id), benchmark, size)
        assert kept.columns == [*docs.columns, "leaks"] and {r.doc_id for r in kept.collect()} == left
