"""The registered queries against their SQL, and the driver's view of them."""

import zlib

import pytest

import __spark_entry__ as E
from halyard.llm.queries import QUERIES, table
from halyard.llm.sql import OP6_LAYOUT, SQL
from tests.oracle_compare import compare, duck_connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF)


def test_registered():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
    assert [int(k[2:].split("_")[0]) for k in QUERIES if k != "pipeline"] == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, duck, key):
    problems, *_ = compare(spark, duck, key, QUERIES[key], SQL[key], SF)
    assert not problems, problems


def test_shards(spark, duck):
    got = QUERIES["op6_histogram_shards"](spark, SF)
    layout = lambda s, d: got.select("doc_id", "size", "shard", "slot")
    problems, *_ = compare(spark, duck, "op6", layout, OP6_LAYOUT, SF)
    assert not problems, problems
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" for r in got.collect())
