"""Every registered query against its DuckDB SQL oracle on the driver
tables (sf0.001 here; tests/oracle_compare.py runs any scale)."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare, duck_connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# The entity queries; the corpus queries have tests of their own.
QUERIES = E.QUERIES
SQL = {key: E.with_views(sql) for key, sql in E.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert len(QUERIES) == 81


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, duck, key):
    problems, n, m, _secs = compare(spark, duck, key, QUERIES[key], SQL[key], SF)
    assert not problems, problems
