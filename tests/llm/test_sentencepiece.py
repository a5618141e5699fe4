import random

import public_tokenizers
import pytest

from corvine.llm import sentencepiece as sp

MODEL = sp.read_model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(MODEL)


def scanned(pieces, text, size, inside=False):
    """The ids by matrices and states of chunks; inside: cut at any place, in the middle of words."""
    text = sp.BLANK + text.replace(" ", sp.BLANK)
    at = [*range(0, len(text), size), len(text)] if inside else pieces.cuts(text, size)
    at = at[:-2] + at[-1:] if len(at) > 2 and at[-1] - at[-2] <= pieces.longest else at
    parts = [(text[max(0, a - sp.REACH) : a], text[a:b], text[b : b + sp.REACH]) for a, b in zip(at, at[1:])]
    states = sp.states_between([pieces.matrix(*p) for p in parts], 0, 0)
    return [i for p, a, b in zip(parts, states, states[1:]) for i in pieces.part(*p, a, b)]


def unigram():
    """A model written by hand: syllables of random scores, and bytes."""
    r = random.Random(7)
    model = sp.proto.ModelProto()
    model.ParseFromString(MODEL)
    del model.pieces[:]
    model.trainer_spec.model_type = sp.UNIGRAM
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id = 0, 1, 2
    found = {"<unk>": 2, "<s>": 3, "</s>": 3} | {f"<0x{b:02X}>": 6 for b in range(256)}
    letters = "abcdefgh"
    found |= dict.fromkeys([*letters, sp.BLANK, *(a + b for a in letters for b in letters), *("".join(r.choice(letters) for _ in range(n)) for n in (3, 4, 5, 6) for _ in range(60)), *(sp.BLANK + "".join(r.choice(letters) for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(30)), "xyz"], 1)
    for piece, kind in found.items():
        model.pieces.add(piece=piece, score=-r.uniform(1, 9) * len(piece) ** 0.7 if kind == 1 else 0.0, type=kind)
    return model.SerializeToString()


def test_scan_gives_the_librarys_ids(pieces):
    r = random.Random(11)
    kinds = ["abcdefghijklmnop", "the of and ing tion", "aaaa", "    a b", "日本語です。", "é𝒳ß\n\t\x00", "Thntheinganderedion", " ▁x", "==--##", "aeioutnrsh"]
    for n in range(120):
        kind = r.choice(kinds)
        text = "".join(r.choice(kind if r.random() < 0.9 else r.choice(kinds)) for _ in range(r.randrange(100, 900)))
        for size in (64, 100):
            assert scanned(pieces, text, size) == pieces.processor.encode(text), (n, size)
            assert scanned(pieces, text, size, inside=True) == pieces.processor.encode(text), (n, size)


def test_cuts_inside_words_carry_states(pieces):
    """Words without a blank near a cut: matrices of several states, of which one path is right."""
    r = random.Random(5)
    text = " ".join("".join(r.choice(["tion", "ment", "er", "ing", "th", "a", "un"]) for _ in range(40)) for _ in range(20))
    full = sp.BLANK + text.replace(" ", sp.BLANK)
    sizes = {pieces.matrix(full[max(0, a - sp.REACH) : a], full[a : a + 50], full[a + 50 : a + 50 + sp.REACH]).shape for a in range(50, 500, 50)}
    assert max(x for x, _ in sizes) > 3
    assert scanned(pieces, text, 50, inside=True) == pieces.processor.encode(text)


def as_good(own, got, want):
    """The same ids, or, where pieces can change places (f ff, ff f), as good a path of the same text."""
    worth = lambda ids: sum(own.score.get(i, 0.0) for i in ids)
    return got == want or (abs(worth(got) - worth(want)) < 1e-9 and own.processor.decode(got) == own.processor.decode(want) and len(got) == len(want))


def test_unigram_model_with_true_scores(spark):
    own = sp.pieces_of(unigram())
    assert isinstance(own, sp.Unigram)
    r = random.Random(3)
    for n in range(60):
        text = "".join(r.choice("abcdefgh" if r.random() < 0.85 else " xyzé") for _ in range(r.randrange(60, 700)))
        for size, inside in ((64, False), (40, True), (90, True)):
            assert as_good(own, scanned(own, text, size, inside), own.processor.encode(text)), (n, size)
    texts = ["".join(r.choice("abcdefgh" if r.random() < 0.97 else " é") for _ in range(4000)), "abc fed", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in sp.encode(docs, unigram(), chunk=150, giant=1000, decoded=True).collect()}
    assert all(got[i].decoded == t and (got[i].ids is None if t is None else as_good(own, got[i].ids, own.processor.encode(t))) for i, t in enumerate(texts))


def test_groups_of_groups(spark, pieces, monkeypatch):
    """Three levels of the scan give what one fold over all matrices gives."""
    monkeypatch.setattr(sp, "FAN", 3)
    r = random.Random(9)
    text = "".join(r.choice("tionheareds ") for _ in range(2500))
    docs = spark.createDataFrame([(1, text), (2, text[::-1])], "doc_id long, text string")
    got = {x.doc_id: x.ids for x in sp.encode(docs, MODEL, chunk=120, giant=500).collect()}
    assert got == {1: pieces.processor.encode(text), 2: pieces.processor.encode(text[::-1])}


def test_a_chunks_ends_give_its_matrix(pieces):
    r = random.Random(4)
    shorter = 0
    for own, kinds in ((pieces, ["tionheareds", "ab  c", "er ing", "日本é x", "aeiout"]), (sp.pieces_of(unigram()), ["abcdefgh", "abc é", "  a"])):
        for n in range(150):
            kind = r.choice(kinds) + " " * (n % 2)
            text = "".join(r.choice(kind if r.random() < 0.95 else r.choice(kinds)) for _ in range(500)).replace(" ", sp.BLANK)
            a = r.randrange(0, 150)
            b = r.choice([len(text), r.randrange(a + 60, 450)])
            left, body, right = text[max(0, a - sp.REACH) : a], text[a:b], text[b : b + sp.REACH]
            ends = own.ends(left, body, right)
            shorter += len(ends) < len(body)
            assert own.matrix(left, ends, right).tolist() == own.matrix(left, body, right).tolist(), n
    assert shorter > 100


def test_product_is_associative():
    import numpy as np

    g = np.random.default_rng(1)
    a, b, c = (np.where(g.random((n, m)) < 0.5, sp.NEVER, g.random((n, m)).round(3)) for n, m in ((3, 4), (4, 5), (5, 2)))
    assert np.allclose(sp.product(sp.product(a, b), c), sp.product(a, sp.product(b, c)))


def test_tables(spark, pieces, folder):
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh ") for _ in range(3000))
    unbroken = "".join(r.choice("tionhear") for _ in range(2000))
    texts = [None, "", " ", "a", long, long, unbroken, "x▁y", "tab\tnew\nline  two 𝒳", "é" * 1500]
    docs = spark.createDataFrame([(i, t, "n", [1]) for i, t in enumerate(texts)], "doc_id long, text string, key string, ids array<int>")
    encoded = sp.encode(docs, MODEL, chunk=500, giant=1000)
    for done in (sp.decode(encoded, MODEL), sp.decode(encoded, MODEL, many=50), sp.encode(docs, MODEL, chunk=500, giant=1000, decoded=True)):
        got = {r.doc_id: r for r in done.collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i].ids == (None if t is None else pieces.processor.encode(t))
            assert got[i].decoded == (None if t is None else t.replace("▁", " ")), i
    assert sp.encode(docs.limit(0), MODEL).count() == 0
    rows = sp.round_trip(spark.read.parquet(f"{folder}/documents.parquet"), MODEL, chunk=1000, giant=4000).collect()
    assert len(rows) == 200 and all(x.same for x in rows)


def shuffled(spark, make):
    """Bytes that the stages of an action write for shuffles, and bytes that it leaves in the checkpoint folder."""
    from corvine.llm.common import shared_folder

    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def measured():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())), files.getContentSummary(root).getLength()

    before = measured()
    make()
    return tuple(b - a for a, b in zip(before, measured(), strict=True))


def test_giant_texts_take_little_disk(spark, tmp_path):
    """Texts that don't compress: a giant text is shuffled once as chunks and once as what it decodes to, with two bytes an id, and no text is
    kept in between."""
    r = random.Random(8)
    letters = "".join(map(chr, [*range(97, 123), *range(65, 91), 32, 32, 32]))
    docs = spark.createDataFrame([(i, "".join(r.choice(letters) for _ in range(60000))) for i in range(8)], "doc_id long, text string").repartition(4)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be sent to all tasks
    try:
        written, kept = shuffled(spark, lambda: sp.round_trip(docs, MODEL).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert written < 4 * 8 * 60000
    assert kept < 8 * 60000 / 2
    rows = sp.round_trip(docs, MODEL).collect()
    assert len(rows) == 8 and all(x.same for x in rows)
