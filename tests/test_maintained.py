"""Maintained counts and the expiry histogram against full scans; trigram
search, collations, references in one pass and heavy keys."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from halyard.operators import changes as CH
from halyard.operators import integrity as I
from halyard.operators import lifecycle as L
from halyard.operators import maintained as MC
from halyard.operators import metrics as M
from halyard.operators import ngrams as NG
from halyard.operators import views as V
from halyard.operators.joins import dimension_join, heavy_keys
from halyard.operators.replay import replay_changes
from halyard.session import AS_OF
from halyard.sources.fixtures import fixture_tables, overlay
from tests.test_replay import SCHEMA, change

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark, SF)


def same(counts, t):
    assert MC.maintained_dashboard(counts, t, AS_OF).collect() == M.dashboard_stats(t, AS_OF).collect()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(MC.maintained_customer_count(counts, t)) == key(M.customer_count(t))
    want = {(r["measure"], r["key"]): (r["n"], r["amount"]) for r in MC.initial_counts(t).collect()}
    assert {(r["measure"], r["key"]): (r["n"], r["amount"]) for r in counts.collect()} == want


def test_counts_after_each_write_equal_a_full_scan(spark, t):
    counts = MC.fold_counts(MC.initial_counts(t))
    same(counts, t)
    # inserts: no rows before
    rows = spark.createDataFrame([(1, 5, 1, "2001-08-05T12:00:00Z", 10.5), (2, 6, 2, "2001-08-08T12:00:00Z", None)],
                                 "row_id bigint, customer_id bigint, package_id bigint, expires_at string, price_paid double")
    new, _ = CH.insert_batch(t, rows, "customer_packages", AS_OF)
    new = new.drop("row_id")
    t2 = overlay(t, customer_packages=t["customer_packages"].unionByName(new))
    counts = MC.fold_counts(counts, ("customer_packages", None, new))
    same(counts, t2)
    # patches and deletes of customers, with the cascade
    edits = [change(1, 5, status="churned", company_id=3), change(2, 6, op="delete"), change(3, 7, company_id=None),
             change(4, 8, status="bogus"), change(5, 6, notes="late")]
    after, outcomes = replay_changes(t2, spark.createDataFrame(edits, SCHEMA), "customers", AS_OF)
    ids = outcomes.where("outcome IN ('updated', 'deleted')").select("id")
    old, now = MC.touched_images(t2["customers"], after["customers"], ids)
    assert {r["id"] for r in old.collect()} == {5, 6, 7} and {r["id"] for r in now.collect()} == {5, 7}
    gone = t2["customer_packages"].where("customer_id = 6")
    counts = MC.fold_counts(counts, ("customers", old, now), ("customer_packages", gone, None))
    same(counts, after)
    # W1, with the images found by comparing the tables
    expired = L.auto_expire(after["customer_packages"], AS_OF)
    old, now = MC.changed_images(after["customer_packages"], expired)
    assert old.count() == now.count() == L.auto_expire_count(after["customer_packages"], AS_OF).first()[0]
    same(MC.fold_counts(counts, ("customer_packages", old, now)), overlay(after, customer_packages=expired))


def test_random_horizons(spark, t):
    """Fractional horizons, ends on a row's very time, none and negative ones."""
    r = random.Random(4)
    cp = t["customer_packages"].where("status = 'active'").select("expires_at").collect()
    days = [Decimal(str(round(r.uniform(0, 400), 6))) for _ in range(40)] + [Decimal(0), Decimal("-1.5"), Decimal("0.000001")]
    for x in r.sample(cp, 20):
        days.append(Decimal((x["expires_at"] - AS_OF) // dt.timedelta(microseconds=1)) / Decimal(86_400_000_000))
    horizons = spark.createDataFrame([(k, d) for k, d in enumerate(days)], "k bigint, days decimal(20,6)")
    hist = MC.expiry_histogram(t["customer_packages"])
    got = {x["k"]: x["expiring"] for x in MC.expiring_counts(hist, t["customer_packages"], horizons, AS_OF).collect()}
    for k, d in enumerate(days):
        micros = int((d.quantize(Decimal("0.000001")) * 86400).quantize(Decimal("0.000001")) * 1_000_000)
        end = AS_OF + dt.timedelta(microseconds=micros)
        assert got[k] == sum(AS_OF <= x["expires_at"] <= end for x in cp), d
    kept = MC.histogram_of_counts(MC.initial_counts(t))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, hist.collect()))


def test_only_edge_hours_are_read(t):
    text = MC.maintained_dashboard(MC.initial_counts(t).limit(0), t, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert "2001-08-08 12:00" in text and "2001-08-08 13:00" in text


@pytest.mark.parametrize("term", ["build", "ING.1", "example.com", "er", "", "10%", "a_b", "zzz", "Customer", "000000001", "É", "x\\"])
def test_indexed_search_finds_what_the_scan_finds(spark, t, term):
    odd = spark.createDataFrame([(9001, "Éva", "Müller"), (9002, "éVA", "x"), (9003, "", "ab"), (9004, "a_b", "10%"), (9005, None, None)],
                                "id bigint, first_name string, last_name string")
    base = t["customers"].select("id", "first_name", "last_name", "email").unionByName(odd.withColumn("email", F.lit(None).cast("string")))
    got = NG.indexed_search(base, NG.postings(base), term)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in V.filter_customers(base, search=term).collect())


def test_written_index_reads_few_folders(spark, t, tmp_path):
    path = str(tmp_path / "grams")
    NG.write_postings(NG.postings(t["customers"]), path, buckets=32)
    found = NG.read_postings(spark, path, ["niu", "itu"], buckets=32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(gram_bucket" in plan or "gram_bucket" in plan.split("PartitionFilters")[1][:200]
    assert len(found.inputFiles()) <= 2 or spark.read.parquet(path).count() > found.count()
    hits = NG.indexed_search(t["customers"], lambda g: NG.read_postings(spark, path, g, 32), "niture")
    assert hits.count() == V.filter_customers(t["customers"], search="niture").count() > 0


def test_collated_names(spark, demo):
    names = ["Zebra", "apple", "Äpfel", "Apple", "apple", "zebra", "Eclair", "éclair", "eclair"]
    rows = [(k, n, None, None, None, AS_OF, AS_OF) for k, n in enumerate(names)]
    t = overlay(demo, companies=spark.createDataFrame(rows, demo["companies"].schema))
    order = lambda c: [r["id"] for r in V.company_list(t, collation=c).collect()]
    assert order(None) == [3, 6, 0, 1, 4, 8, 5, 2, 7]  # by bytes
    assert order("UNICODE_CI") == [2, 1, 3, 4, 6, 8, 7, 0, 5]  # f before p
    assert order("UNICODE_CI_AI") == [2, 1, 3, 4, 6, 7, 8, 0, 5]
    asked = spark.createDataFrame([(1, "APPLE"), (2, "ECLAIR"), (3, "ÉCLAIR"), (4, "none"), (5, None)], "row_id bigint, name string")
    by = lambda c, small: {r["row_id"]: r["resolved_id"] for r in V.resolve_by_name(
        asked, t["companies"], "name", collation=c, small=small).collect()}
    for small in (None, True):
        assert by(None, small) == {1: None, 2: None, 3: None, 4: None, 5: None}
        assert by("UNICODE_CI", small) == {1: 1, 2: 6, 3: 7, 4: None, 5: None}
        assert by("UNICODE_CI_AI", small) == {1: 1, 2: 6, 3: 6, 4: None, 5: None}


def test_references_in_one_pass(spark, t):
    from halyard.plans.catalog_writes import _reference_check
    plan = _reference_check(t)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 5  # two children, three parents
    assert plan.count("Join ") == 1, plan


def test_hot_missing_reference(spark):
    child = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 999).when(F.col("id") % 3 == 1, F.col("id") % 50).alias("fk"))
    parent = spark.range(40)
    got = I.orphan_report([("a", child, "fk", parent, "id"), ("b", child, "id", parent, "id")])
    want = {("a", i, 999 if i % 3 == 0 else i % 50) for i in range(3000) if i % 3 == 0 or i % 3 == 1 and i % 50 >= 40} | {
        ("b", i, i) for i in range(40, 3000)}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("how", ["left", "inner"])
def test_heavy_keys_are_not_shuffled(spark, how):
    """Two heavy keys, one that the dimension lacks, rare keys, NULLs."""
    rows = spark.range(6000).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 AND id % 2 = 0 THEN 7777 "
                                                 "WHEN id % 7 = 0 THEN NULL ELSE id END").alias("fk"), F.lit("x").alias("other"))
    dim = spark.range(3000).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
                                   F.when(F.col("id") % 2 == 0, F.col("id")).alias("value"))
    assert {r["key"] for r in heavy_keys(rows, "fk", 100).collect()} == {1, 7777}
    got = dimension_join(rows, dim, "fk", how, small=False, share=100)
    want = rows.join(dim.withColumnRenamed("id", "k"), F.col("fk") == F.col("k"), how).drop("k")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
    light = rows.join(heavy_keys(rows, "fk", 100), F.col("fk") == F.col("key"), "left_anti").where("fk IS NOT NULL")
    assert light.groupBy("fk").count().agg(F.max("count")).first()[0] == 1
