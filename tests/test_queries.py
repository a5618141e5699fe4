"""Every registered query with SQL gives the rows that DuckDB gives; the others give rows."""

import re

import __spark_entry__
import pytest
from compare import duck, rows

from corvine.operators import registry

registry.load()


@pytest.fixture(scope="module")
def connection(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, folder, connection, name):
    assert rows(registry.QUERIES[name](spark, folder).toPandas()) == rows(connection.sql(registry.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, folder, name):
    assert registry.QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "similarity", "vector_score", "bm25_score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_optional_part(tmp_path, spark):
    """The entry point imports, and offers the other queries, when the optional folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__spark_entry__.__file__).parent
    shutil.copytree(here / "corvine", tmp_path / "corvine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_every_node_has_its_ancestors(spark, folder):
    from corvine.plans.relational import organizations
    from corvine.sources.tables import table

    nodes = {r.node for r in organizations(lambda name: table(spark, folder, name)).collect()}
    got = registry.QUERIES["hierarchy_recursive_up_all"](spark, folder).collect()
    print("rows", len(got), "before", registry.QUERIES["hierarchy_recursive_up"](spark, folder).count())
    assert {r.node for r in got if r.distance == 0} == nodes


def test_next_code_past_three_digits(spark, tmp_path):
    """Keys of more than three digits are codes in full, as in the SQL."""
    import duckdb

    spark.range(5, 1235).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert registry.QUERIES["next_sequence_code"](spark, str(tmp_path)).first()[0] == own.sql(registry.ORACLE["next_sequence_code"]).df().iloc[0, 0] == "Supplier-1235"


def test_words_are_counted_in_their_rows(spark, tmp_path):
    """No row for a word and document is grouped by both; repeated and null doc_ids are counted as SQL counts them."""
    import duckdb

    texts = ["The cat sat; the CAT", "cat dog", None, "", "dog dog bird"]
    for name, ids in (("once", [1, 2, 3, 4, None]), ("repeated", [1, 1, 2, 2, None])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        own = duckdb.connect()
        own.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        found = registry.QUERIES["tokens_word"](spark, folder)
        assert bool(re.search(r"Aggregate \[word#\d+, doc_id", found._jdf.queryExecution().optimizedPlan().toString())) == (name == "repeated")
        assert rows(found.toPandas()) == rows(own.sql(registry.ORACLE["tokens_word"]).df())
