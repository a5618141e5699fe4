import random
import zlib

import numpy as np

from corvine.llm import langid


def test_features():
    assert langid.features(None) is None and langid.features("12 %%%\n") is None
    a = langid.features("Ça va bien")
    assert abs(a @ a - 1) < 1e-9
    assert np.allclose(langid.features("ab, cd"), langid.features("AB   CD"))


def test_slices(monkeypatch):
    text = "der die das und nicht " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_SLICE", 100)
    assert np.abs(langid.features(text) - whole).max() < 0.1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.languages(docs, 300).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    accuracy = sum(r.lang == r.lang_pred for r in held) / len(held)
    print("held-out", len(held), accuracy)
    assert len(rows) == 1000 and accuracy > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    text = {"en": "the of and to in is that with", "de": "der die das und nicht ist mit von", "fr": "le la les des une est dans pour"}
    rows = [(i, f"{text[lang]} {i}", lang) for i in range(60) for lang in [list(text)[i % 3]]]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", "fr"), (None, text["fr"], "fr"), (103, "nicht das " * 30000, None), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.languages(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (100, 101, 102, None, 103)] == ["und", "und", "und", "fr", "de"]
    assert all(by[i].lang_pred == list(text)[i % 3] for i in range(60))
    assert langid.languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.languages(docs.where("lang IS NULL")).collect()} == {"und"}
    assert {r.lang_pred for r in langid.languages(docs.where("lang = 'en' AND doc_id < 60")).collect()} == {"en"}


def test_machine_is_optimal():
    """Primal and dual objectives meet, on classes that overlap."""
    g = np.random.default_rng(0)
    x = np.concatenate([g.standard_normal((150, 12)), g.standard_normal((100, 12)) + 0.7])
    y = np.array([-1] * 150 + [1] * 100)
    for c in (1.0, 100.0):
        w = langid.machine([(np.arange(12), row) for row in x], y, 12, c, epochs=3000, enough=1e-7)
        margins = y * (x @ w[:-1] + w[-1])
        loss = np.maximum(0, 1 - margins)
        primal = w @ w / 2 + c / len(x) * (loss**2).sum()
        alpha = 2 * c / len(x) * loss  # where the minimum is
        full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        dual = alpha.sum() - ((alpha * y) @ full) @ ((alpha * y) @ full) / 2 - len(x) / (4 * c) * (alpha**2).sum()
        assert abs(primal - dual) < 1e-4 * primal


def speak(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def test_close_languages_within_families(spark):
    """Two families of three languages each, which share nine of ten words and differ in endings; predictions equal plain votes."""
    r = random.Random(4)
    letters = {"romance": "aeiou lmnprst", "slavic": "aeiou jkvzhdg"}
    rows, names = [], {"romance": ["es", "pt", "it"], "slavic": ["ru", "uk", "pl"]}
    for family, langs in names.items():
        stems = ["".join(r.choice(letters[family].replace(" ", "")) for _ in range(r.randrange(2, 7))) for _ in range(300)]
        for n, lang in enumerate(langs):
            own = stems[:270] + [s + ending for s, ending in zip(stems[270:], (["o", "am", "ie"][n] for _ in range(30)))]
            rows += [(lang, speak(r, own, r.randrange(60, 120))) for _ in range(80)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert sorted(model.families.names) == ["romance", "slavic"] and {f: sorted(m.names) for f, m in model.languages.items()} == {f: sorted(n) for f, n in names.items()}
    got = {x.doc_id: x for x in langid.languages(docs).collect()}
    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    right = sum(got[i].lang_pred == rows[i][0] for i in held) / len(held)
    print("held out", len(held), "right", right)
    assert right >= 0.9

    def votes(machines, v):
        won = dict.fromkeys(machines.names, 0.0)
        for (a, b), w, bias in zip(machines.pairs, machines.weights, machines.bias):
            chance = 1 / (1 + np.exp(-3 * (sum(p * q for p, q in zip(w, v) if q) + bias)))
            won[machines.names[a]] += chance
            won[machines.names[b]] += 1 - chance
        return max(sorted(won), key=lambda n: won[n])

    for i in held[:20]:
        v = langid.features(rows[i][1])
        assert got[i].lang_pred == votes(model.languages[votes(model.families, v)], v)
