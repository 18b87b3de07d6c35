"""Every registered query gives the rows of its SQL twin on the test tables."""

import os
from collections import Counter

import duckdb
import pytest

from clicktide.plans.catalog import all_queries
from clicktide.plans.oracle import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()

TYPES = {
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
}


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    files = f"{SF_DIR}/events.parquet"
    files += "/*.parquet" if os.path.isdir(files) else ""
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{files}'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, oracle, name):
    ours = QUERIES[name](spark, SF_DIR)
    theirs = oracle.execute(ORACLE[name])
    columns = [d[0] for d in theirs.description]
    assert {n: TYPES[t] for n, t in ours.dtypes} == {d[0]: str(d[1]) for d in theirs.description}
    expected = _rows(columns, theirs.fetchall())
    assert expected, "the twin should return rows"
    assert _rows(ours.columns, ours.collect()) == expected
