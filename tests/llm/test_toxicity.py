import math
import re
import zlib
from collections import Counter

import numpy as np

from corvine.llm import toxicity as tx


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def brute(docs, labels, k=25):
    """Scores of texts by cosines with all examples, in plain Python and without fit: docs are (id, text), labels (id, toxic)."""
    cut = lambda t: Counter(re.findall(r"\w+", (t or "").lower()))
    known: dict = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and not out(i):
            known[i] = max(y, known.get(i, 0))
    examples: dict = {}
    for i, t in docs:
        if i in known:
            key = (frozenset(cut(t)), known[i])
            if key not in examples or i < examples[key][0]:
                examples[key] = (i, cut(t), known[i])
    rows = sorted(examples.values(), key=lambda r: r[0])
    if not rows:
        return [0.5] * len(docs)
    df = Counter(w for _, t in docs for w in cut(t))
    held, bad = Counter(w for _, c, _ in rows for w in c), Counter(w for _, c, y in rows if y for w in c)
    rate = sum(y for *_, y in rows) / len(rows)
    tested = [w for w in held if bad[w] >= 3 and bad[w] > held[w] * rate]

    def evidence(w):
        other = held[w] - bad[w]
        return bad[w] * math.log(bad[w] / (held[w] * rate)) + (other * math.log(other / (held[w] * (1 - rate))) if other else 0)

    factor = {w: 1 + evidence(w) for w in tested if evidence(w) > math.log(max(1, len(tested))) + 4} if 0 < rate < 1 else {}
    worth = {w: (math.log((len(docs) + 1) / (df[w] + 1)) + 0.1) * factor.get(w, 1) for w in held}

    def unit(c):
        v = {w: (1 + math.log(n)) * worth[w] for w, n in c.items() if w in worth}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    vectors, base = [unit(c) for _, c, _ in rows], (sum(y for *_, y in rows) + 0.5) / (len(rows) + 1)

    def votes(v, leave=None):
        sims = [(-round(sum(x * u.get(w, 0) for w, x in v.items()), 10), rows[e][0], rows[e][2]) for e, u in enumerate(vectors) if e != leave]
        near = sorted(s for s in sims if s[0] < 0)[:k]
        return (sum(-s * y for s, _, y in near) + base) / (sum(-s for s, *_ in near) + 1)

    own = [votes(v, e) for e, v in enumerate(vectors)]
    got = np.array([votes(unit(cut(t))) for _, t in docs])
    return got if not 0 < rate < 1 else np.interp(got, *tx.isotonic(np.array(own), np.array([y for *_, y in rows]), base))


def test_scores_equal_brute_force(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [(r.doc_id, r.toxic) for r in labels.collect()])
    got = {r.doc_id: r.score for r in tx.toxicity(docs, labels).collect()}
    assert max(abs(got[i] - s) for (i, _), s in zip(rows, want, strict=True)) < 1e-6


def test_nearest_is_exact():
    """Few frequent and many rare terms, small blocks: the same neighbours as by all cosines."""
    g = np.random.default_rng(3)
    n, terms = 700, 400
    share = 1 / np.arange(1, terms + 1) ** 0.7
    rows = [np.sort(g.choice(terms, size=g.integers(1, 30), replace=False, p=share / share.sum())) for _ in range(n)]
    rows[5:25] = [rows[4]] * 20  # equal vectors: ties
    dense = np.zeros((n, terms))
    for e, at in enumerate(rows):
        w = g.random(len(at)) + 0.1 if not 4 <= e < 25 else np.ones(len(at))
        dense[e, at] = w / np.sqrt(w @ w)
    starts, cols = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    for rare, block in ((20, 16), (0, 64), (1000, 8)):
        model = tx.Model({f"t{i}": i for i in range(terms)}, g.random(terms) + 1, starts, cols, np.concatenate([dense[e, at] for e, at in enumerate(rows)]), (np.arange(n) % 3 == 0).astype(int), np.arange(n)[::-1].copy(), k=10, block=block, rare=rare)
        found = [Counter({f"t{i}": int(g.integers(1, 4)) for i in g.choice(terms, size=g.integers(1, 20), replace=False)} | {"other": 3}) for _ in range(100)] + [Counter(f"t{i}" for i in rows[4]), Counter()]
        at, weight, begins = model.vectors(found)
        for own, a, b, (near, sims) in zip(found, begins, begins[1:], model.nearest(at, weight, begins)):
            query = np.zeros(terms)
            for w, many in own.items():
                if w != "other":
                    query[int(w[1:])] = (1 + np.log(many)) * model.weight_of[int(w[1:])]
            query /= max(np.sqrt(query @ query), 1e-300)
            assert np.allclose(query[at[a:b]], weight[a:b]) and (query > 0).sum() == b - a
            all_sims = np.round(dense @ query, 10)
            want = [e for e in np.lexsort((model.ids, -all_sims)) if all_sims[e] > 0][:10]
            assert near.tolist() == want and np.allclose(sims, all_sims[want])


def test_isotonic():
    g = np.random.default_rng(1)
    votes = g.random(400)
    toxic = (g.random(400) < votes**2).astype(int)
    x, y = tx.isotonic(votes, toxic, 0.3)
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 <= y.min() and y.max() <= 1
    assert np.mean((np.interp(votes, x, y) - toxic) ** 2) < np.mean((0.3 - toxic) ** 2)


def test_held_out_accuracy(spark):
    """On the table of ten thousand documents: held-out rows are classed by words that only training rows taught, and scores are
    probabilities."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = tx.toxicity(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic", "evidence").collect()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    hits = sum(r.predicted and r.toxic for r in held)
    precision, recall = hits / max(1, sum(r.predicted for r in held)), hits / sum(r.toxic for r in held)
    brier = sum((r.score - r.toxic) ** 2 for r in held) / len(held)
    print("held-out", len(held), "precision", precision, "recall", recall, "brier", brier)
    assert precision > 0.95 and recall > 0.85 and brier < 0.02
    for low, high in ((0.0, 0.1), (0.9, 1.01)):
        part = [r for r in held if low <= r.score < high]
        assert abs(sum(r.score for r in part) - sum(r.toxic for r in part)) / len(part) < 0.03


def test_only_copies_count_once(spark):
    """Texts that share most words are examples of their own; texts of one word set and label are one."""
    rows = [(i, "common words of a language that all texts share " + f"own{i} mark{i} " + ("fool" if i % 3 == 0 else "nice")) for i in range(300)]
    rows += [(1000 + i, rows[i][1].upper() + "!") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 1000 % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    learnt = {(frozenset(tx.words(t)), i % 1000 % 3 == 0) for i, t in rows if not out(i)}
    assert (len(model.ids), model.toxic.sum()) == (len(learnt), sum(toxic for _, toxic in learnt))
    assert set(model.terms) == {w for words, _ in learnt for w in words}


def test_model_is_sent_once(spark, monkeypatch):
    """Learning the curve and scoring share one broadcast; the words that are counted are let go on the driver, too."""
    rows = [(i, f"text{i} of several words " + ("fool" if i % 3 == 0 else "nice")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    sent, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(broadcast(value)) or sent[-1])
    model = tx.fit(docs, labels)
    got = {r.doc_id: r.toxicity.score for r in tx.score(docs, model).collect()}
    assert len(sent) == 2 and not sent[0]._jbroadcast.isValid() and sent[1]._jbroadcast.isValid()
    assert model.curve is not None and got == {i: score for (i, _), (score, _, _) in zip(rows, model.scores([t for _, t in rows]), strict=True)}


def test_bounded_sample(spark):
    rows = [(i, f"text{i} of several words " + ("fool" if i % 3 == 0 else "nice")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    assert 50 < len(tx.fit(docs, labels, max_examples=100).ids) < 150
    assert 60 < len(tx.fit(docs, labels, max_words=500).ids) < 140


def test_odd_rows(spark):
    rows = [(i, f"plain words number {i} " + ("you awful fool" if i % 4 == 0 else "nice day")) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "awful fool"), (202, "fool " * 20000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "own", "s") for r in rows], "doc_id long, text string, toxicity string, __id string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(80)] + [(0, 1, "x"), (None, 1, "x"), (5, None, "x"), (999, 1, "x")], "doc_id long, toxic int, text string")
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[202].predicted == 1 and by[None].predicted == 1 and by[200].predicted == 0 and by[201].score == by[200].score
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 80)
    assert "fool" in by[202].evidence
    kept = tx.without_toxic(docs, labels)
    assert kept.schema == docs.schema and {200, 201, 1}.issubset({r.doc_id for r in kept.collect()})
    assert {r.toxicity for r in kept.collect()} == {"own"}
    nothing = tx.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5} and tx.toxicity(docs.limit(0), labels).count() == 0
