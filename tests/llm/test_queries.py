"""The registered queries of the operators against their SQL twins."""

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from clicktide.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "conversations")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        files = f"{SF_DIR}/{name}.parquet"
        files += "/*.parquet" if os.path.isdir(files) else ""
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return connection


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_operator_has_one_query():
    numbers = [int(m[1]) for name in driver.queries() if (m := re.match(r"op(\d+)_", name))]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in driver.queries()
    assert set(queries.ORACLE) <= set(queries.all_queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, oracle, name):
    ours = driver.queries()[name](spark, SF_DIR)
    theirs = oracle.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    expected = _rows(columns, theirs.fetchall())
    assert expected and _rows(ours.columns, ours.collect()) == expected


SHAPES = {
    "op1_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint",
             "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean",
             "kept": "boolean"},
    "op4_": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op6_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint",
              "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string",
              "collapsed_sha256": "string"},
    "op12_": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint",
              "codebooks_sha256": "string"},
    "op13_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("start", sorted(SHAPES))
def test_shapes(spark, start):
    name = next(name for name in driver.queries() if name.startswith(start))
    found = driver.queries()[name](spark, SF_DIR)
    assert SHAPES[start].items() <= dict(found.dtypes).items()
    table = {"op6_": "embeddings", "op7_": "pages", "op12_": "embeddings"}.get(start, "documents")
    if start != "op6_":
        assert found.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
