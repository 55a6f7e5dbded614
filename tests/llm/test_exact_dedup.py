import re
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from halyard.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SPACE = re.compile("[ \t-\r]+")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, keep, len(ids), k == 0, sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_edges_and_forced_collisions(edge_docs, no_docs):
    want = brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert result(exact_duplicates(edge_docs)) == want
    # every hash the same: bytes alone decide
    assert result(exact_duplicates(edge_docs, digest=lambda c: F.lit("x"))) == want
    # hashes that some different texts share
    assert result(exact_duplicates(edge_docs, digest=lambda c: F.substring(F.md5(c), 1, 1))) == want
    assert exact_duplicates(no_docs).count() == 0


def test_drop_keeps_columns_and_all_texts(edge_docs):
    out = drop_exact_duplicates(edge_docs)
    assert out.columns == edge_docs.columns
    norm = lambda df: sorted(SPACE.sub(" ", r.text or "") for r in df.collect())
    assert norm(out) == sorted(set(norm(edge_docs)))  # one row of each text
    assert out.filter("doc_id = 100").count() == 0
    assert out.filter("doc_id = 3").count() == 2  # one row of each of its texts


def test_one_row_of_a_table_appended_twice(spark):
    """A third of the ids are null, and every row is there twice."""
    rows = [(None if k % 3 == 0 else k, f"t {k // 2}", "s") for k in range(60)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = exact_duplicates(docs)
    assert got.filter("kept").count() == 30 and result(got) == brute([(i, t) for i, t, _ in rows])
    assert sorted(r.text for r in drop_exact_duplicates(docs).collect()) == sorted({t for _, t, _ in rows})


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(
        F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    got = exact_duplicates(docs)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 and keep_id = 0").count() == 1000
