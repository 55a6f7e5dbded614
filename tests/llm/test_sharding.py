import random
import zlib

from pyspark.sql import functions as F

from halyard.llm.sharding import histogram_splitters, shard_by_bytes


def nearest(rows, n):
    """Splitters by a full sort: the edge between keys nearest to each target."""
    by = {}
    for key, size in rows:
        by[key] = by.get(key, 0) + size
    total, edges, upto = sum(by.values()), [], 0
    for key in sorted(by):
        edges.append((upto, key))
        upto += by[key]
    edges.append((upto, None))
    return [min(abs(b * n - k * total) for b, _ in edges) for k in range(1, n)], total


def off(rows, cuts, n):
    total = sum(s for _, s in rows)
    return [abs(sum(s for key, s in rows if key < c) * n - k * total) for k, c in enumerate(cuts, 1)]


def test_splitters_are_the_nearest_edges(spark):
    r = random.Random(2)
    sets = {
        "even": [(r.randrange(1 << 52), r.randrange(1, 500)) for _ in range(2000)],
        "crowded": [(r.randrange(1 << 20), r.randrange(1, 500)) for _ in range(1500)],
        "hot key": [(12345, 10)] * 700 + [(r.randrange(1 << 52), 10) for _ in range(700)],
        "one huge": [(r.randrange(1 << 52), 1) for _ in range(300)] + [(1 << 40, 100_000)],
        "ends": [(0, 5), ((1 << 52) - 1, 5), (7, 5)]}
    for name, rows in sets.items():
        frame = spark.createDataFrame(rows, "key long, size long")
        for n in (2, 7):
            cuts = histogram_splitters(frame, n)
            want, total = nearest(rows, n)
            assert off(rows, cuts, n) == want and cuts == sorted(cuts), name
    rough = histogram_splitters(spark.createDataFrame(sets["even"], "key long, size long"), 5, tolerance=0.05)
    assert max(off(sets["even"], rough, 5)) <= 0.05 * sum(s for _, s in sets["even"])


def test_edges(edge_docs, no_docs):
    rows = shard_by_bytes(edge_docs, 4).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(
        (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in edge_docs.collect())
    for s in {r.shard for r in rows}:
        assert 0 <= s < 4 and sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shard_by_bytes(no_docs, 4).count() == 0


def test_parts_number_without_gaps(spark, monkeypatch):
    from halyard.llm import sharding

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pmod(hash(id), 90) as int))").alias("text"))
    whole = {r.doc_id: (r.shard, r.slot) for r in shard_by_bytes(docs, 6).collect()}
    monkeypatch.setattr(sharding, "PART_ROWS", 60)
    assert whole == {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(docs, 6).collect()}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = shard_by_bytes(docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_rows_without_an_id_are_cut_apart(spark):
    """A third of the ids are null and a third are one id: all shards get
    their share of bytes."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(
        F.col("id")).cast("long").alias("doc_id"), F.lit("0123456789").alias("text"))
    got = shard_by_bytes(docs, 24).groupBy("shard").agg(F.sum("size").alias("bytes"), F.max("slot").alias("last"),
                                                        F.count("*").alias("n")).collect()
    assert len(got) == 24 and all(r.last == r.n - 1 for r in got)
    share = 20_000 * 18 / 24
    assert all(abs(r.bytes - share) < 0.03 * share for r in got), got
