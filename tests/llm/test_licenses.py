import random
from itertools import combinations

from corvine.llm import licenses as lic


def test_increasing_is_longest():
    r = random.Random(2)
    for _ in range(200):
        values = r.sample(range(20), r.randrange(0, 9))
        got = [values[i] for i in lic.increasing(values)]
        assert got == sorted(got)
        longest = max(n for n in range(len(values) + 1) if any(list(c) == sorted(c) for c in combinations(values, n)))
        assert len(got) == longest


def test_align_matches_equal_words_in_order():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randrange(0, 20))] for _ in range(2))
        pairs = lic.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    words = [f"w{i}" for i in range(50)]
    assert lic.align(words, words) == [(i, i) for i in range(50)]


KNOWN = lic.known_templates()


def test_planted_licenses_are_found():
    """With up to a tenth of the words replaced; in notices and headers, those that tell no license from another."""
    r = random.Random(5)
    pool = [f"x{i}" for i in range(300)] + [w for w in lic.words(" ".join(t for n, t in KNOWN if n not in lic.FILES)) if not lic.telling([w])]
    templates = [lic.Template(n, lic.words(t), 0.8) for n, t in KNOWN]
    for t in templates:
        for share in (0, 0.05, 0.1):
            hits, tries = 0, 3 if t.long else 20
            free = [i for i, w in enumerate(t.tokens) if not lic.telling([w])]
            for _ in range(tries):
                own = list(t.tokens)
                for _ in range(int(share * len(own))):
                    own[r.choice(free)] = r.choice(pool)
                text = " ".join(r.choices(pool, k=300) + own + r.choices(pool, k=300))
                hits += any(f[0] == t.name and abs(f[1] - 300) <= 0.2 * len(own) + 3 for f in lic.scan_text(text, [t]))
            assert hits >= 0.9 * tries, (t.name, share, hits)
    clean = [" ".join(r.choices(pool, k=1000)) for _ in range(30)]
    assert not any(lic.scan_text(c, templates) for c in clean)


def test_name_version_and_conditions_decide():
    templates = [lic.Template(n, lic.words(t), 0.8) for n, t in KNOWN]
    for text, want in {
        "Released under the Apache License.": [],
        "Licensed under CC BY 4.0": ["CC-BY-4.0 notice"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0 notice"],
        "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0 notice"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0 notice"],
        "Licensed under CC BY-NC-SA 3.0.": ["CC-BY-NC-SA-3.0 notice"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0 notice"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0 notice"],
        "This work is licensed under the GNU General Public License.": [],
        "Licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1 notice"],
        "Licensed under the GPLv3.": ["GPL-3.0 notice"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0 notice"],
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["CC-BY-4.0 notice"],
        "Licensed under the MIT License.": ["MIT notice"],
    }.items():
        assert [f[0] for f in lic.scan_text(f"Some work. {text} More text follows", templates)] == want, text


def test_overlapping_templates_give_the_best():
    templates = [lic.Template(n, lic.words(t), 0.8) for n, t in KNOWN]
    for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "Apache-2.0 header"):
        assert [f[0] for f in lic.scan_text(dict(KNOWN)[name], templates)] == [name]
    texts = dict(KNOWN)
    for name in lic.FILES:  # the whole Apache text holds its header
        edited = texts[name].replace("license", "licence", 7)
        assert [f[0] for f in lic.scan_text(f"before {texts[name]} between {edited} after", templates)] == [name, name]


def test_adjacent_copies_are_found_each():
    """Copies one after the other, as in NOTICE files, whole, with words put in or taken out; parts equal those of all windows."""
    r = random.Random(6)
    for name, text in KNOWN:
        if name in lic.FILES:
            continue
        t = lic.Template(name, lic.words(text), 0.8)
        for copies in (1, 2, 3, 4):
            for edits in (0, len(t.tokens) // 12):
                tokens, planted = ["before", "it"], []
                for n in range(copies):
                    own = list(t.tokens)
                    for k in range(edits):
                        at = r.randrange(1, len(own) - 1)
                        own[at:at] = [f"put{k}"]
                        del own[r.choice([i for i in range(1, len(own) - 1) if not lic.telling([own[i]])])]
                    tokens += ["copyright", f"y200{n}", "someone"]
                    planted.append((len(tokens), len(tokens) + len(own)))
                    tokens += own
                got = [f[1:3] for f in t.found([*tokens, "after"])]
                if edits == 0:
                    assert got == planted, (name, copies)
                assert len(got) == copies and all(min(x[1], y[1]) - max(x[0], y[0]) > 0.7 * len(t.tokens) for x, y in zip(got, planted, strict=True)), (name, copies, got, planted)
                windows = [(b, lic.align(t.tokens, tokens[b : b + t.width])) for b in range(len(tokens))]
                for b, pairs in windows:  # what any window holds meets a part that was found
                    if t.holds(tokens, [(i, b + j) for i, j in pairs]):
                        assert any(b + pairs[0][1] < y and x < b + pairs[-1][1] + 1 for x, y in got)


def test_odd_rows(spark):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, f"a {notice} b\n{notice}"), (4, "... !!"), (5, "word " * 20000 + notice), (5, "word " * 20000 + notice), (None, lic.TEXTS["ISC"].upper())]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    got = sorted(((r.doc_id, r.license, r.start, r.coverage) for r in lic.licenses(docs).collect()), key=str)
    assert got == sorted([(3, "MIT notice", 1, 1.0), (3, "MIT notice", 7, 1.0), (5, "MIT notice", 20000, 1.0), (5, "MIT notice", 20000, 1.0), (None, "ISC", 0, 1.0)], key=str)
    assert lic.licenses(docs.limit(0)).count() == 0


def test_lines_of_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {(r.doc_id, r.license) for r in lic.licenses(docs).collect()}
    want = {(d.doc_id, n) for d in docs.collect() for n, t in KNOWN if f" {' '.join(lic.words(t))} " in f" {' '.join(lic.words(d.text))} "}
    assert want and want <= got
