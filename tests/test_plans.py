"""Physical plan checks: scans read only what they need, dimensions are
broadcast behind their bound, metrics read each table once, hot keys are
combined before the shuffle."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from halyard.operators import lifecycle as L
from halyard.operators import metrics as M
from halyard.operators import views as V
from halyard.operators.ids import assign_ids
from halyard.sources.fixtures import fixture_tables
from halyard.session import AS_OF

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dashboard_reads_each_table_once(spark):
    t = fixture_tables(spark, SF)
    p = M.dashboard_stats(t, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    # customers, companies (nation), packages (part), subscriptions (orders)
    assert p.count("Relation ") == 4


def test_enriched_broadcasts_dimensions(spark):
    t = fixture_tables(spark, SF)
    p = plan(V.subscription_enriched(t))
    assert "BroadcastHashJoin" in p


def test_scan_prunes_columns(spark):
    t = fixture_tables(spark, SF)
    df = V.expiring_within(t, 30, AS_OF)
    p = df._jdf.queryExecution().executedPlan().toString()
    # orders is read with only the columns the view derives the rows from.
    scans = [ln for ln in p.split("\n") if "FileScan parquet" in ln and "orders" in ln]
    assert scans and all("o_comment" not in ln for ln in scans)


def test_current_subscription_limits_before_shuffle(spark):
    t = fixture_tables(spark, SF)
    p = plan(V.current_subscription(t))
    assert "WindowGroupLimit" in p


def test_fold_is_partially_aggregated(spark):
    from halyard.operators.changes import fold_changes
    t = fixture_tables(spark, SF)
    p = fold_changes(t["customer_changes"])._jdf.queryExecution().sparkPlan().toString()
    assert p.count("HashAggregate") + p.count("ObjectHashAggregate") + \
        p.count("SortAggregate") >= 2


def test_digest_is_lines_not_one_row(spark):
    t = fixture_tables(spark, SF)
    lines = L.digest_lines(V.reminder_candidates(t, 30, AS_OF), 30)
    assert "collect_list" not in plan(lines)


def test_ids_use_range_partitioning(spark):
    t = fixture_tables(spark, SF)
    cp = t["customer_packages"].select("id", "expires_at")
    big = assign_ids(cp, 0, ["expires_at", "id"], partitions=8, id_col="seq")
    # The partitioned way: rows were range-partitioned and written once; only
    # the partition counts (one row per partition) meet in one place.
    p = big._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in p and "SinglePartition" not in p and "Window" not in p
    by_default = assign_ids(cp, 0, ["expires_at", "id"], id_col="seq")
    p = by_default._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in p and "Window" not in p
    want = cp.withColumn("seq", F.row_number().over(Window.orderBy("expires_at", "id")).cast("bigint"))
    assert big.count() == 15000
    assert big.exceptAll(want.select(big.columns)).count() == 0
    assert by_default.exceptAll(want.select(by_default.columns)).count() == 0


def test_small_batches_do_not_shuffle_the_table(spark):
    """With Spark's own size-based broadcast off, a few patches or deletes
    still reach a big table through broadcast keys: no sort-merge join."""
    from halyard.operators import changes as CH
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = fixture_tables(spark, SF)
        patches = spark.createDataFrame([(1, True, "inactive"), (2, True, "churned")],
                                        "id bigint, set_status boolean, status string")
        new, out = CH.patch_batch(t, patches, "customers", AS_OF)
        for df in (new, out):
            assert "SortMergeJoin" not in plan(df)
        keys = spark.createDataFrame([(3,), (4,)], "id bigint")
        new, out = CH.delete_batch(t, "customers", keys)
        for df in (new["customers"], new["customer_packages"], out):
            assert "SortMergeJoin" not in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_digest_reads_its_candidates_once(spark):
    """Count and lines read the candidates written once: no join is left in
    the plan, and no sort of rows whose order nobody reads."""
    t = fixture_tables(spark, SF)
    p = plan(L.digest_lines(V.reminder_rows(t, 30, AS_OF), 30))
    assert "Join" not in p.replace("BroadcastNestedLoopJoin", "") and "rangepartitioning" not in p


def test_write_batches_are_read_from_one_written_table(spark):
    """The request batch of J6 and W4 is a join of fixture tables; the checks
    read it from the table written first, so the plans stay short."""
    from halyard.operators import changes as CH
    t = fixture_tables(spark, SF)
    cust, subs, rejected = CH.create_with_subscription(t, t["customer_requests"], AS_OF)
    for df in (cust, subs, rejected):
        assert plan(df).count("FileScan parquet") <= 2
    rows = CH.assign_if_none(t, t["assignment_requests"], AS_OF)
    assert plan(rows).count("FileScan parquet") <= 2
