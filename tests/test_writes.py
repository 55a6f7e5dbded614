"""Write path on the demo rows: inserts, patches, deletes, checks."""

import datetime as dt

from pyspark.sql import functions as F

from halyard.operators import changes as CH
from halyard.operators import integrity as I
from halyard.operators import validation as VAL
from halyard.operators.ids import assign_ids
from halyard.sources import schemas as S
from halyard.sources import tables as TB
from tests.demo_rows import T


def test_insert_subscriptions(demo, spark):
    rows = spark.createDataFrame(
        [(1, 1, 2, "2001-09-01T00:00:00Z", 10.0, "expired"),      # ok, status forced active
         (2, 99, 2, "2001-09-01T00:00:00Z", None, None),          # unknown customer
         (3, 2, 2, "2001-09-01", 5.0, None),                      # no time part
         (4, 3, 1, "2001-09-01T00:00:00.5Z", -1.0, None)],        # negative price
        "row_id bigint, customer_id bigint, package_id bigint, expires_at string, "
        "price_paid double, status string")
    ins, rej = CH.insert_batch(demo, rows, "customer_packages", T)
    got = ins.collect()
    assert [(r["row_id"], r["id"], r["status"], r["joined_at"]) for r in got] == \
        [(1, 6, "active", T)]
    errs = {r["row_id"]: r["errors"] for r in rej.collect()}
    assert errs == {2: ["customer_id:no_parent"], 3: ["expires_at:datetime"],
                    4: ["price_paid:too_small"]}


def test_insert_customers_unique_email(demo, spark):
    rows = spark.createDataFrame(
        [(1, "A", "B", "new@x.com"), (2, "C", "D", "new@x.com"), (3, "E", "F", "alice@acme.com"),
         (4, "", "G", "other@x.com")],
        "row_id bigint, first_name string, last_name string, email string")
    ins, rej = CH.insert_batch(demo, rows, "customers", T)
    assert [(r["row_id"], r["id"], r["status"]) for r in ins.collect()] == [(1, 7, "active")]
    errs = {r["row_id"]: r["errors"] for r in rej.collect()}
    assert errs == {2: ["unique:email"], 3: ["unique:email"], 4: ["first_name:too_short"]}


def test_create_with_subscription_both_or_neither(demo, spark):
    sub = "struct<package_id:bigint,promotion_id:bigint,joined_at:string,expires_at:string,price_paid:double>"
    rows = spark.createDataFrame(
        [(1, "A", "B", "a@x.com", {"package_id": 1, "promotion_id": None, "joined_at": None,
                                   "expires_at": "2001-09-01T00:00:00Z", "price_paid": 29.0}),
         (2, "C", "D", "c@x.com", {"package_id": 9, "promotion_id": None, "joined_at": None,
                                   "expires_at": "2001-09-01T00:00:00Z", "price_paid": None}),
         (3, "E", "F", "e@x.com", None)],
        f"row_id bigint, first_name string, last_name string, email string, subscription {sub}")
    cust, subs, rej = CH.create_with_subscription(demo, rows, T)
    assert [(r["row_id"], r["id"]) for r in cust.orderBy("row_id").collect()] == [(1, 7), (3, 8)]
    assert [(r["id"], r["customer_id"], r["package_id"]) for r in subs.collect()] == [(6, 7, 1)]
    assert [r["row_id"] for r in rej.collect()] == [2]


def test_patch_absent_vs_null(demo, spark):
    patches = spark.createDataFrame(
        [(1, True, None, True, "inactive"),     # clear notes, set status
         (2, False, "ignored", False, None),    # nothing set: rejected
         (42, True, "x", False, None)],         # unknown id
        "id bigint, set_notes boolean, notes string, set_status boolean, status string")
    new, out = CH.patch_batch(demo, patches, "customers", T + dt.timedelta(days=1))
    alice = new.where("id = 1").first()
    assert alice["notes"] is None and alice["status"] == "inactive"
    assert alice["updated_at"] == T + dt.timedelta(days=1)
    carol = new.where("id = 3").first()
    assert carol["notes"] == "Renewal due soon" and carol["updated_at"] == T
    assert {r["id"]: r["outcome"] for r in out.collect()} == \
        {1: "updated", 2: "rejected", 42: "not_found"}


def test_patch_rejects_bad_value(demo, spark):
    patches = spark.createDataFrame([(1, True, "paused")], "id bigint, set_status boolean, status string")
    new, out = CH.patch_batch(demo, patches, "customers", T)
    assert out.first()["outcome"] == "rejected"
    assert new.where("id = 1").first()["status"] == "active"


def test_delete_rules(demo, spark):
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    # CASCADE customer -> subscriptions; SET NULL subscription -> log.
    new, out = CH.delete_batch(demo, "customers", keys(2, 77))
    assert {r["id"]: r["outcome"] for r in out.collect()} == {2: "deleted", 77: "not_found"}
    assert new["customers"].count() == 5
    assert [r["id"] for r in new["customer_packages"].orderBy("id").collect()] == [1, 3, 4, 5]
    assert new["notification_log"].first()["customer_package_id"] is None
    # SET NULL company -> customers.
    new, _ = CH.delete_batch(demo, "companies", keys(1))
    assert new["customers"].where("company_id IS NULL").count() == 3
    # RESTRICT: a package in use stays; CASCADE to package_promotions otherwise.
    new, out = CH.delete_batch(demo, "packages", keys(1))
    assert out.first()["outcome"] == "restricted" and new["packages"].count() == 3
    # SET NULL promotion -> subscriptions, CASCADE -> package_promotions.
    new, _ = CH.delete_batch(demo, "promotions", keys(1))
    assert new["customer_packages"].where("id = 4").first()["promotion_id"] is None
    assert [r["id"] for r in new["package_promotions"].collect()] == [2]


def test_fold_change_stream(demo, spark):
    ch = spark.createDataFrame(
        [(1, 1, "patch", True, "inactive", False, None),
         (3, 1, "patch", True, "churned", False, None),
         (2, 1, "patch", False, None, True, None),       # explicit NULL notes
         (4, 2, "delete", False, None, False, None),
         (5, 2, "patch", True, "active", False, None)],  # after the delete: not found
        "seq bigint, id bigint, op string, set_status boolean, status string, "
        "set_notes boolean, notes string")
    folded = CH.fold_changes(ch)
    new, out = CH.apply_folded(demo, folded, "customers", T)
    alice = new["customers"].where("id = 1").first()
    assert alice["status"] == "churned" and alice["notes"] is None
    assert new["customers"].where("id = 2").count() == 0
    assert new["customer_packages"].where("customer_id = 2").count() == 0
    assert {r["id"]: r["outcome"] for r in out.collect()} == {1: "updated", 2: "deleted"}


def test_reference_and_unique_checks(demo, spark):
    child = spark.createDataFrame([(1, 1), (2, 5), (3, None)], "row_id bigint, package_id bigint")
    orph = I.orphans(child, demo["packages"], "package_id").collect()
    assert [r["row_id"] for r in orph] == [2]
    batch = spark.createDataFrame([(1, 2, 1), (2, 2, 1), (3, 3, 1)],
                                  "id bigint, package_id bigint, promotion_id bigint")
    rep = I.duplicate_report([("pp", batch, demo["package_promotions"],
                               ["package_id", "promotion_id"])]).collect()
    assert sorted((r["key"], r["n_rows"], r["in_table"]) for r in rep) == [("2/1", 2, True)]


def test_validators_types(spark):
    pk = spark.createDataFrame([(1, "P", 10.0, 30.5), (2, "Q", -1.0, 0.0), (3, "R", 1.0, 30.0)],
                               "row_id bigint, name string, price double, duration_days double")
    rep = {r["row_id"]: r["errors"] for r in VAL.validation_report(pk, "packages").collect()}
    assert rep == {1: "duration_days:integer", 2: "price:too_small|duration_days:too_small", 3: ""}
    pr = spark.createDataFrame(
        [(1, "S", 120.0, "2024-02-30T00:00:00Z", "2024-12-31T23:59:59.5Z"),
         (2, "T", 50.0, "2024-02-29T00:00:00Z", "2024-01-01T00:00:00+02:00")],
        "row_id bigint, name string, discount_percent double, valid_from string, valid_until string")
    rep = {r["row_id"]: r["errors"] for r in VAL.validation_report(pr, "promotions").collect()}
    assert rep == {1: "discount_percent:too_big|valid_from:datetime", 2: "valid_until:datetime"}
    dt_ok = {r[0]: r[1] for r in spark.createDataFrame(
        [(1, "2000-02-29T00:00:00Z"), (2, "1900-02-29T00:00:00Z"), (3, "2023-02-29T00:00:00Z"),
         (4, "2024-04-31T00:00:00Z"), (5, "2024-12-31T23:59:59.123456Z"), (6, "2024-1-01T00:00:00Z"),
         (7, "2024-01-01T24:00:00Z")], "row_id bigint, s string")
        .select("row_id", VAL.is_utc_datetime(F.col("s"))).collect()}
    assert dt_ok == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False}
    em = spark.createDataFrame([(1, "a.b@ex.co"), (2, ".a@ex.co"), (3, "a..b@ex.co"),
                                (4, "a@ex"), (5, "o'neil+x@mail.example.org")],
                               "row_id bigint, email string")
    ok = {r[0]: r[1] for r in em.select("row_id", VAL.is_email(F.col("email"))).collect()}
    assert ok == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_assign_ids_matches_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").alias("v"))
    got = assign_ids(df, 100, ["k", "v"], id_col="new_id", partitions=7)
    want = df.select("k", "v", (F.row_number().over(Window.orderBy("k", "v")) + 100).alias("w"))
    bad = got.join(want, ["k", "v"]).where("new_id <> w").count()
    assert bad == 0 and got.count() == 5000
    assert got.agg(F.min("new_id"), F.max("new_id")).first() == (101, 5100)


def test_insert_if_absent_and_assign_if_none(demo, spark):
    new = spark.createDataFrame([(1, "Acme Corp"), (2, "Hooli"), (3, "Hooli")],
                                "row_id bigint, name string")
    rows = TB.insert_if_absent(demo["companies"], new, ["name"], "row_id").collect()
    assert [(r["id"], r["name"], r["row_id"]) for r in rows] == [(5, "Hooli", 2)]
    req = spark.createDataFrame(
        [(1, "david@umbrella.com", "Basic", None, T, T + dt.timedelta(days=30), 29.0, "active"),
         (2, "alice@acme.com", "Basic", None, T, T, 29.0, "active"),      # has an active one
         (3, "david@umbrella.com", "Enterprise", None, T, T, 1.0, "active")],  # second for David
        "seq bigint, customer_email string, package_name string, promotion_name string, "
        "joined_at timestamp_ntz, expires_at timestamp_ntz, price_paid double, status string")
    got = CH.assign_if_none(demo, req, T).collect()
    assert [(r["seq"], r["id"], r["customer_id"], r["package_id"]) for r in got] == [(1, 6, 4, 1)]


def test_write_and_load_round_trip(spark):
    import tempfile
    from halyard.operators import lifecycle as L
    from halyard.operators import metrics as M
    from halyard.sources.fixtures import fixture_tables
    from halyard.sources.schemas import TABLES
    t = fixture_tables(spark, "/root/testdata/sf0.001")
    base = tempfile.mkdtemp(prefix="tables-", dir="/tmp")
    for name in TABLES:
        TB.write_table(t[name], base, name, 1,
                       partition_by=["status"] if name == "customer_packages" else None)
    # A second version of the subscriptions after W1; loads pick it.
    TB.write_table(L.auto_expire(t["customer_packages"], T), base, "customer_packages", 2,
                   partition_by=["status"], sort_by=["expires_at"])
    loaded = TB.load_tables(spark, base)
    assert {n: loaded[n].count() for n in TABLES} == {n: t[n].count() for n in TABLES}
    assert [(f.name, f.dataType) for f in loaded["customer_packages"].schema] == \
        [(f.name, f.dataType) for f in TABLES["customer_packages"]]
    assert L.auto_expire_count(loaded["customer_packages"], T).first()[0] == 0
    want = M.dashboard_stats(t, T).first().asDict()
    got = M.dashboard_stats(loaded, T).first().asDict()
    assert got["active_customers"] == want["active_customers"]
    assert got["expired_subscriptions"] >= want["expired_subscriptions"]
    # The active-only scan of a status-partitioned table prunes partitions.
    plan = loaded["customer_packages"].where("status = 'active'")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    # On stored tables the expiry horizon reaches the scan as pushed filters.
    from halyard.operators import views as V
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        scan = V.expiring_within(loaded, 30, T)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    line = [ln for ln in scan.split("\n") if "FileScan parquet" in ln and "status=" not in ln
            and "expires_at" in ln][0]
    assert "GreaterThanOrEqual(expires_at" in line and "LessThanOrEqual(expires_at" in line
    assert "PartitionFilters: [isnotnull(status" in line


def test_insert_other_entities(demo, spark):
    pk = spark.createDataFrame(
        [(1, "Team", None, 49.5, 30.0, ["a", "b"], None), (2, "Bad", None, 10.0, 0.5, None, False)],
        "row_id bigint, name string, description string, price double, duration_days double, "
        "features array<string>, active boolean")
    ins, rej = CH.insert_batch(demo, pk, "packages", T)
    row = ins.first()
    assert (row["id"], row["active"], row["duration_days"], row["features"]) == \
        (4, True, 30, ["a", "b"])
    assert [r["errors"] for r in rej.collect()] == [["duration_days:integer", "duration_days:too_small"]]
    pr = spark.createDataFrame(
        [(1, "Spring", 15.0, None, "2001-09-01T00:00:00Z", "2001-10-01T00:00:00.250Z")],
        "row_id bigint, name string, discount_percent double, discount_amount double, "
        "valid_from string, valid_until string")
    row = CH.insert_batch(demo, pr, "promotions", T)[0].first()
    assert row["id"] == 3 and row["valid_until"] == dt.datetime(2001, 10, 1, 0, 0, 0, 250000)
    assert row["active"] is True and float(row["discount_percent"]) == 15.0
    co = spark.createDataFrame([(1, "Hooli", "info@hooli.com"), (2, "X", "not-mail")],
                               "row_id bigint, name string, email string")
    ins, rej = CH.insert_batch(demo, co, "companies", T)
    assert [(r["id"], r["name"]) for r in ins.collect()] == [(5, "Hooli")]
    assert [r["errors"] for r in rej.collect()] == [["email:email"]]


def test_patch_packages_and_promotions(demo, spark):
    p = spark.createDataFrame([(2, True, 89.0, False, None), (3, False, None, True, False)],
                              "id bigint, set_price boolean, price double, "
                              "set_active boolean, active boolean")
    new, out = CH.patch_batch(demo, p, "packages", T)
    got = {r["id"]: (float(r["price"]), r["active"]) for r in new.collect()}
    assert got == {1: (29.0, True), 2: (89.0, True), 3: (199.0, False)}
    bad = spark.createDataFrame([(1, True, -5.0)], "id bigint, set_price boolean, price double")
    assert CH.patch_batch(demo, bad, "packages", T)[1].first()["outcome"] == "rejected"
    pr = spark.createDataFrame([(1, True, None)],
                               "id bigint, set_discount_percent boolean, discount_percent double")
    new, _ = CH.patch_batch(demo, pr, "promotions", T)
    assert new.where("id = 1").first()["discount_percent"] is None


def _patches(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, id bigint, op string, set_email boolean, email string, "
                                       "set_status boolean, status string, set_notes boolean, notes string")


def test_patch_may_keep_its_own_email(spark, demo):
    p = _patches(spark, [(1, 1, "patch", True, "alice@acme.com", False, None, True, "new")])
    new, out = CH.patch_batch(demo, p, "customers", T)
    assert out.first()["outcome"] == "updated"
    assert new.where("id = 1").first()["notes"] == "new"
    other = demo["customers"].where("id = 2").first()["email"]
    p = _patches(spark, [(1, 1, "patch", True, other, False, None, False, None)])
    assert CH.patch_batch(demo, p, "customers", T)[1].first()["outcome"] == "rejected"


def test_each_patch_is_checked_by_itself(spark, demo):
    p = _patches(spark, [(1, 1, "patch", False, None, True, "inactive", False, None),
                         (2, 1, "patch", False, None, True, "bogus", False, None),
                         (3, 1, "patch", False, None, False, None, True, "x" * 2001),
                         (4, 2, "patch", False, None, True, None, False, None),
                         (5, 3, "patch", False, None, False, None, False, None)])
    new, out = CH.patch_batch(demo, p, "customers", T)
    assert [tuple(r) for r in out.select("seq", "outcome", "errors").orderBy("seq").collect()] == [
        (1, "updated", ""), (2, "rejected", "status:enum"), (3, "rejected", "notes:too_long"),
        (4, "rejected", "status:required"), (5, "rejected", "no_fields")]
    assert new.where("id = 1").first()["status"] == "inactive"
    assert new.where("status is null").count() == 0


def test_several_patches_without_an_order_are_rejected(spark, demo):
    p = _patches(spark, [(1, 1, "patch", False, None, False, None, True, "a"),
                         (2, 1, "patch", False, None, False, None, True, "b")]).drop("seq", "op")
    new, out = CH.patch_batch(demo, p, "customers", T)
    assert [r["outcome"] for r in out.collect()] == ["rejected"]
    assert new.count() == demo["customers"].count()


def test_restricted_delete_keeps_the_patches(spark, demo):
    ch = spark.createDataFrame([(1, 1, "patch", True, "One"), (2, 1, "delete", False, None),
                                (3, 1, "patch", True, "Two")],
                               "seq bigint, id bigint, op string, set_name boolean, name string")
    new, out = CH.apply_folded(demo, CH.fold_changes(ch), "packages", T)
    assert sorted(r["outcome"] for r in out.collect()) == ["restricted", "updated"]
    assert new["packages"].where("id = 1").first()["name"] == "Two"


def test_absent_column_and_oversize_number_reject_rows_not_the_batch(spark, demo):
    rows = spark.createDataFrame([(1, "A", "B")], "row_id bigint, first_name string, last_name string")
    new, rejected = CH.insert_batch(demo, rows, "customers", T)
    assert new.count() == 0 and rejected.first()["errors"] == ["email:required"]
    rows = spark.createDataFrame([(1, "big", 1e12, 30), (2, "fits", 10.0, 30)],
                                 "row_id bigint, name string, price double, duration_days int")
    new, rejected = CH.insert_batch(demo, rows, "packages", T)
    assert [r["name"] for r in new.collect()] == ["fits"]
    assert rejected.first()["errors"] == ["price:too_big"]


def test_counts_past_the_int_range(spark):
    from halyard.operators.metrics import company_metrics

    assert company_metrics({"companies": spark.range(3_000_000_000)}).first()[0] == 3_000_000_000


def test_ids_of_deleted_rows_are_not_issued_again(spark, demo, tmp_path):
    """The top customer deleted and the table written: a new customer gets a
    fresh id, also after a version whose side file was lost."""
    import os
    from halyard.operators.ids import next_id
    base = str(tmp_path)
    for name in S.TABLES:
        TB.write_table(demo[name], base, name, 1)
    kept = demo["customers"].where("id < 6")
    TB.write_table(kept, base, "customers", 2)
    t = TB.load_tables(spark, base)
    assert t["customers"].agg({"id": "max"}).first()[0] == 5
    assert next_id(t, "customers") == 6
    assert next_id(t, "companies") == demo["companies"].agg({"id": "max"}).first()[0]
    os.remove(os.path.join(base, "customers", "v=2", TB.LAST_ID))
    assert TB.last_issued_id(spark, base, "customers") == 6
    TB.write_table(kept.where("false"), base, "customers", 3)
    assert TB.last_issued_id(spark, base, "customers") == 6
    TB.write_table(kept, base, "customers", 4)
    TB.drop_old_versions(spark, base, "customers", 2)
    assert sorted(os.listdir(os.path.join(base, "customers"))) == ["v=3", "v=4"]
    assert TB.load_tables(spark, base)["customers"].count() == 5
