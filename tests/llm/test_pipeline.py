"""The pipeline's stages against plain versions, and the registered queries against their SQL."""

import corpus_pipeline
import pytest
import sentencepiece
from compare import duck, rows
from test_decontam import edit
from test_linededup import brute as brute_lines
from test_simhash import brute_components, brute_fingerprint, brute_similar
from test_toxicity import brute as brute_toxic

from corvine.llm import decontam, queries
from corvine.sources.tables import table


def kept_lines(docs):
    """Texts without their repeated lines."""
    strip = " \t\n\v\f\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    held: dict = {}
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(i)
    keeper = {k: max(ids) for k, ids in held.items() if len(ids) >= 3}
    return {i: "\n".join(x for x in (text or "").split("\n") if keeper.get(key(x), i) == i) for i, text in docs.items()}


def near_groups(docs):
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    ids = sorted(prints)
    return brute_components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])


def test_stages_against_plain_versions(spark, folder):
    documents = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    items = {r.item_id: decontam.words(r.text) for r in table(spark, folder, "benchmark").collect()}
    scores = brute_toxic(list(documents.items()), [(r.doc_id, r.toxic) for r in table(spark, folder, "labels").collect()])
    docs = {i: t for (i, t), score in zip(documents.items(), scores, strict=True) if score < 0.5}
    docs = kept_lines(docs)
    assert len(brute_lines(list(docs.items()))) == len(docs)
    groups = brute_similar(docs)
    docs = {i: t for i, t in docs.items() if groups[i] == i}
    leaked = {i for i, t in docs.items() for tokens in items.values() if set(tokens) & set(decontam.words(t)) and len(set(tokens) - set(decontam.words(t))) <= 0.2 * len(tokens) and edit(tokens, decontam.words(t)) <= int(0.2 * len(tokens))}
    docs = {i: t for i, t in docs.items() if i not in leaked}
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(docs)
    assert all(got[i].text == t and got[i].ids == pieces.encode(t) and got[i].n_tokens == len(got[i].ids) and got[i].n_chars == len(t) for i, t in docs.items())


def test_stages_keep_columns_and_empty_tables(spark, folder):
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert out.count() == 0


def test_stages_keep_odd_rows_and_columns(spark, folder):
    """Null and empty texts, repeated rows, a very long text, null ids, and columns of the names that stages use, through all stages."""
    line = "a line that stands in many of the documents of this table"
    texts = [None, "", f"{line}\nfirst own words here", f"{line}\nsecond own words there", f"{line}\nthird own words", "word " * 60_000 + "end", "copy of a text that comes twice", "copy of a text that comes twice"]
    rows = [(None if i == 7 else 10**9 + i, t, "en", "s", 3, "L", "D", "R", "I", "T", "X", "Y", "Z") for i, t in enumerate(texts)]
    names = ["n_lines", "n_dropped", "runs", "ids", "n_tokens", "__id", "__hash", "decoded"]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert [f for f in out.schema.fields if f.name in names] == [f for f in docs.schema.fields if f.name in names], name
        assert all(tuple(r[n] for n in names) == tuple("LDRITXYZ") for r in out.select(*names).collect()), name
        out.write.mode("overwrite").parquet(path := f"{corpus_pipeline.shared_folder(spark)}/odd-{name}")
        given = spark.read.parquet(path)
    got = given.collect()
    assert given.columns == [*docs.columns, "_ids", "_n_tokens"]
    # of the wordless texts one stays, as of the copies; the repeated line stays in the document of the largest id
    kept = sorted((r.doc_id or 0, (r.text or "")[:18]) for r in got)
    assert kept == sorted([(10**9, ""), (10**9 + 2, "first own words he"), (10**9 + 3, "second own words t"), (10**9 + 4, line[:18]), (10**9 + 5, "word word word wor"), (10**9 + 6, "copy of a text tha")])
    assert all((r._n_tokens or 0) == len(r._ids or []) for r in got) and next(len(r._ids) for r in got if r.doc_id == 10**9 + 5) >= 60_000


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_with_sql(spark, folder, name):
    assert rows(queries.QUERIES[name](spark, folder).toPandas()) == rows(duck(folder).sql(queries.ORACLE[name]).df())


def test_simhash_query(spark, folder):
    documents = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    groups = near_groups(documents)
    got = queries.op1_simhash_dedup(spark, folder).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{brute_fingerprint(t):016x}", groups[i]) for i, t in documents.items()}
