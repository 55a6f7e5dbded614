"""The plan shapes used at scale, on small data.

* Beyond the broadcast bound every join is a shuffle join: the join-heavy
  queries must give the oracle's answer with broadcasts disabled.
* Hot keys: one customer holding a third of all subscriptions, one id a
  third of all changes; results must equal the SQL oracle, with AQE's
  skew-join split forced on.
"""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from halyard.operators import changes as CH
from halyard.operators import joins as J
from halyard.operators import views as V
from halyard.plans.oracle import with_views
from halyard.sources.fixtures import fixture_tables, overlay
from tests.oracle_compare import compare, duck_connect

SF = "/root/testdata/sf0.001"
JOIN_KEYS = ["customer_360", "subscription_enriched", "expiring_within", "reminder_candidates",
             "company_list", "assign_if_none", "insert_batch", "create_with_subscription",
             "patch_batch", "change_stream", "delete_batch", "reference_check", "unique_check",
             "reminder_digest", "key_lookup", "default_terms", "resolve_by_name"]

SHUFFLE_ONLY = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
SKEW = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}


@pytest.fixture()
def shuffle_joins(spark, monkeypatch):
    old = {k: spark.conf.get(k, None) for k in {**SHUFFLE_ONLY, **SKEW}}
    for k, v in {**SHUFFLE_ONLY, **SKEW}.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(J, "BROADCAST_MAX_ROWS", -1)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF)


@pytest.mark.parametrize("key", JOIN_KEYS)
def test_shuffle_join_plans_match_oracle(shuffle_joins, duck, key):
    df = E.queries()[key](shuffle_joins, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Only the per-partition id offsets (one row per partition) may be broadcast.
    data_broadcasts = [ln for ln in plan.split("\n")
                       if "BroadcastHashJoin" in ln and "__part" not in ln]
    assert not data_broadcasts, data_broadcasts
    problems, *_ = compare(shuffle_joins, duck, key, E.queries()[key], E.oracle_sql()[key], SF)
    assert not problems, problems


HOT_CP = "CASE WHEN id % 3 = 0 THEN 0 ELSE customer_id END"


def test_hot_customer(shuffle_joins, duck):
    spark = shuffle_joins
    t = fixture_tables(spark, SF)
    hot = t["customer_packages"].withColumn(
        "customer_id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("customer_id")))
    tt = overlay(t, customer_packages=hot)
    cur = V.current_subscription(tt).select("customer_id", "id").collect()
    sql = with_views(f"""
WITH hot AS (SELECT * REPLACE ({HOT_CP} AS customer_id) FROM customer_packages)
SELECT customer_id, id FROM (
  SELECT customer_id, id, row_number() OVER (PARTITION BY customer_id
                                             ORDER BY expires_at DESC, id DESC) AS rn
  FROM hot WHERE status = 'active') WHERE rn = 1""")
    assert sorted(map(tuple, cur)) == sorted(duck.execute(sql).fetchall())
    enriched = V.subscription_enriched(tt).groupBy("customer_id").count().collect()
    sql = with_views(f"""
WITH hot AS (SELECT * REPLACE ({HOT_CP} AS customer_id) FROM customer_packages)
SELECT h.customer_id, count(*) FROM hot h JOIN customers c ON c.id = h.customer_id
JOIN packages p ON p.id = h.package_id GROUP BY 1""")
    assert sorted(map(tuple, enriched)) == sorted(duck.execute(sql).fetchall())


def test_hot_change_id(shuffle_joins, duck):
    spark = shuffle_joins
    t = fixture_tables(spark, SF)
    hot = t["customer_changes"].withColumn(
        "id", F.when(F.col("seq") % 3 == 0, F.lit(7)).otherwise(F.col("id")))
    folded = CH.fold_changes(hot).select("id", "status", "notes", "deleted").collect()
    sql = with_views("""
WITH ch AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 7 ELSE id END AS id) FROM customer_changes),
ls AS (SELECT id, max(seq) FILTER (WHERE op = 'patch' AND set_status) AS s1,
              max(seq) FILTER (WHERE op = 'patch' AND set_notes) AS s2,
              bool_or(op = 'delete') AS deleted FROM ch GROUP BY id)
SELECT ls.id, a.status, b.notes, ls.deleted FROM ls
LEFT JOIN ch a ON a.seq = ls.s1 LEFT JOIN ch b ON b.seq = ls.s2""")
    assert sorted(map(tuple, folded)) == sorted(duck.execute(sql).fetchall())


def test_wide_rows_are_not_broadcast(spark, tmp_path):
    """Few rows of long texts pass the row bound, not the byte bound; a table
    that grows past it is seen to."""
    from pyspark.sql import functions as F

    from halyard.operators.joins import BROADCAST_MAX_BYTES, is_small, measured_bytes, small_side
    path = str(tmp_path / "wide")
    texts = spark.range(10).select("id", F.repeat(F.lit("x"), 1 << 20).alias("note"),
                                   F.array(F.lit("a"), F.lit("b")).alias("tags"))
    texts.write.parquet(path)
    wide = spark.read.parquet(path)
    assert is_small(wide) and 10 << 20 <= measured_bytes(wide) < 11 << 20
    spark.range(60).select("id", F.repeat(F.lit("x"), 1 << 20).alias("note"),
                           F.array(F.lit("a")).alias("tags")).write.mode("append").parquet(path)
    wide = spark.read.parquet(path)
    assert measured_bytes(wide) > BROADCAST_MAX_BYTES and not is_small(wide)
    assert is_small(wide.select("id"))
    assert "Broadcast" not in small_side(wide)._jdf.queryExecution().analyzed().toString()


def test_rows_without_a_reference_do_not_meet(shuffle_joins):
    """Two thirds of the subscriptions have no promotion: in a shuffle join
    they are spread by their own id."""
    from pyspark.sql import functions as F

    from halyard.operators.joins import spread_nulls
    rows = shuffle_joins.range(1, 30001).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 5 + 1).alias("fk"))
    parents = shuffle_joins.range(1, 6).withColumnRenamed("id", "pid")
    joined = rows.join(parents, spread_nulls("fk") == F.col("pid"), "left")
    assert joined.where("fk <=> pid").count() == joined.count() == 30000
    dealt = rows.where("fk IS NULL").repartition(8, spread_nulls("fk")).groupBy(F.spark_partition_id()).count()
    counts = [r["count"] for r in dealt.collect()]
    assert len(counts) == 8 and max(counts) < 2 * min(counts)
