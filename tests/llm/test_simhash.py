import random

import pytest
import xxhash

from corvine.llm import simhash
from corvine.llm.common import components


def brute_fingerprint(text, words=3):
    tokens = [t for t in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, " \n\t", "one", "One TWO", "Ünë Ä b c d e f", "a b c a b c a b c", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_shingle_hash_is_that_of_spark(spark):
    assert spark.sql("select xxhash64('aé b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest("aé b c".encode(), 42)


@pytest.mark.parametrize("cell", [2000, 3])
def test_links_lose_none(spark, cell):
    r = random.Random(5)
    fps = {0, 1, 3, 7, 15, 2**63, 2**64 - 1}
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {(x.a, x.b) for x in simhash.links(rows, 3, cell).collect()}
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


@pytest.mark.parametrize("cell", [2000, 1])
def test_index_is_not_broadcast(spark, cell):
    """Fingerprints few enough to broadcast become 66 index entries each, and more where a segment is refined."""
    found = simhash.links(spark.createDataFrame([(f,) for f in (0, 1, 3, 2**40)], "fp long"), 3, cell)
    assert {(x.a, x.b) for x in found.collect()} == {(0, 1), (0, 3), (1, 3), (0, 2**40), (1, 2**40), (3, 2**40)}
    met = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "bit_count" in line and "Join" in line]
    assert met and not [line for line in met if "Broadcast" in line]


def test_components(spark):
    r = random.Random(1)
    linked = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    want = brute_components({n for p in linked for n in p}, linked)
    got = {x.node: x.component for x in components(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and set(got) == {n for a, b in linked if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def tasks_of(spark, run):
    """What run() gives, and the number of tasks that it took on shuffles of 61 partitions."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context, group = spark.sparkContext, f"tasks-{random.random()}"
    try:
        for k, v in zip(held, ("61", "false"), strict=True):
            spark.conf.set(k, v)
        context.setJobGroup(group, "counted")
        out, track = run(), context.statusTracker()
        stages = {s for job in track.getJobIdsForGroup(group) for s in track.getJobInfo(job).stageIds}
        return out, sum(info.numCompletedTasks for s in stages if (info := track.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)


def test_components_of_few_links_take_few_tasks(spark):
    linked = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)]
    got, tasks = tasks_of(spark, lambda: {r.node: r.component for r in components(spark.createDataFrame(linked, "a long, b long")).collect()})
    assert got == brute_components({n for pair in linked for n in pair}, linked)
    assert tasks < 1000


def test_near_duplicates_on_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base.replace("w200 ", "other "), None), (9, base, "x"), (9, base, "x"), (1, None, None), (2, "", "y"), (None, base, None), (4, "short text here now", None), (None, "all alone in this", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((x.doc_id, x.component_id) for x in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (9, 3), (1, 1), (2, 1), (None, 3), (4, 4), (None, None)], key=str)
    kept = sorted((x.doc_id for x in simhash.without_near_duplicates(docs).collect()), key=str)
    assert kept == [1, 3, 4, None]
    for drop in (simhash.without_near_duplicates, simhash.without_similar):
        clashing = docs.withColumns({"kept_id": docs.text, "__id": docs.doc_id, "node": docs.fp})
        assert drop(clashing).schema == clashing.schema and drop(docs.limit(0)).count() == 0
        twice = docs.unionByName(docs)
        assert sorted((x.doc_id for x in drop(twice).collect()), key=str) == kept
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    ids = sorted(fps)
    want = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in ids}
    assert {r.doc_id for r in simhash.without_near_duplicates(docs).collect()} == set(want.values())


def brute_similar(texts, words=5, similarity=0.8):
    """Components of texts (by id) by all Jaccard similarities."""
    sets = {}
    for i, t in texts.items():
        tokens = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()
    ids = sorted(texts)
    near = lambda x, y: x == y or len(x & y) >= similarity * len(x | y)
    return brute_components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if near(sets[a], sets[b])])


def family_texts(r):
    """Families whose copies are near the first text and not each other, chains, copies at 0.8 exactly, shared passages."""
    draw = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        base = draw(204)
        texts.append(base)
        for _ in range(30):
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randrange(1, 7)):
                copy[at] = f"new{r.randrange(10**6)}"
            texts.append(copy)
    chain = draw(300)
    for _ in range(20):
        texts.append(list(chain))
        chain[r.randrange(300)] = "other"
        chain[r.randrange(300)] = "more"
    passage = draw(120)
    texts += [passage + draw(r.randrange(60, 240)) for _ in range(80)] + [draw(50) for _ in range(40)] + [[], ["one"], ["One"]]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("block", "rounds"), [(1024, 4), (8, 0), (3, 1), (1, 2)])
def test_links_of_pairs_that_share_a_key(spark, block, rounds):
    """Neither blocks nor rounds change what is joined: all pairs that share a key and are similar, and no others."""
    r = random.Random(8)
    texts = family_texts(r)
    base = [f"x{i}" for i in range(64)]  # many texts that share keys and are near few others
    for _ in range(60):
        copy = list(base)
        for at in r.sample(range(64), r.randrange(1, 4)):
            copy[at] = f"y{r.randrange(10**6)}"
        texts.append(copy)
    rows = simhash._signed(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), 5)
    nodes = {x.node: (set(x["keys"]), set(x.hashes)) for x in rows.collect()}
    ids = sorted(nodes)
    near = lambda a, b: len(nodes[a][1] & nodes[b][1]) >= 0.8 * len(nodes[a][1] | nodes[b][1])
    want = brute_components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if nodes[a][0] & nodes[b][0] and near(a, b)])
    links = simhash.similar(rows, 0.8, block, rounds)
    of = {x.node: x.component for x in components(links).collect()}
    assert {i: of.get(i, i) for i in ids} == want
    assert rounds < 4 or links.count() < 2 * len(ids)  # not all pairs


def test_rounds_only_where_much_is_left(spark, monkeypatch):
    """What is left of few texts goes to blocks at once: no round (and its stages) for it. What is joined is the same as by rounds to the end."""
    rows = simhash._signed(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(family_texts(random.Random(8)))], "doc_id long, text string"), 5)
    asked, merging = [], simhash.merging
    monkeypatch.setattr(simhash, "merging", lambda frame, size: asked.append(size) or merging(frame, size))
    joined = lambda links: sorted(map(tuple, components(links).collect()))
    at_once = joined(simhash.similar(rows))
    assert not asked
    assert joined(simhash.similar(rows, rest=0)) == at_once
    assert asked


@pytest.mark.parametrize(("block", "rounds"), [(256, 4), (8, 0)])
def test_similar_texts(spark, block, rounds):
    texts = family_texts(random.Random(8))
    documents = {i: " ".join(t) for i, t in enumerate(texts)}
    want = brute_similar(documents)
    rows = simhash._signed(spark.createDataFrame(list(documents.items()), "doc_id long, text string"), 5)
    of = {x.node: x.component for x in components(simhash.similar(rows, 0.8, block, rounds)).collect()}
    got: dict = {}
    for x in rows.collect():
        got.setdefault(of.get(x.node, x.node), []).append(x.doc_id)
    found = {i: min(ids) for ids in got.values() for i in ids}
    assert all(want[found[i]] == want[i] for i in documents)  # nothing is joined that isn't near
    missed = sum(found[i] != want[i] for i in documents)
    print("components", len(set(want.values())), "documents not with their component's first", missed)
    assert missed <= 2


def test_similar_on_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute_similar({r.doc_id: r.text for r in docs.collect()})
    kept = {r.doc_id for r in simhash.without_similar(docs).collect()}
    assert set(want.values()) <= kept and len(kept) <= len(set(want.values())) + 1
