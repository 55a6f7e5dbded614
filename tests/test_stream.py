"""W11 as Structured Streaming: the fold over many micro-batches equals the
batch fold, and the foreachBatch writer reaches the same final table."""

import os
import tempfile

from pyspark.sql import functions as F

from halyard.operators import changes as CH
from halyard.sources import schemas as S
from halyard.streaming.change_stream import (apply_change_stream, change_source, fold_stream, read_bucketed,
                                             latest_version)
from tests.demo_rows import T


def _changes(spark):
    rows = [(i, None, (i % 6) + 1, "delete" if i == 17 else "patch",
             i % 2 == 0, ["active", "inactive", "churned"][i % 3] if i % 2 == 0 else None,
             i % 2 == 1, None if i % 5 == 0 else f"note {i}")
            for i in range(1, 41)]
    return spark.createDataFrame(rows, S.CUSTOMER_CHANGES)


def _write_files(df, path, n):
    df = df.withColumn("__b", F.col("seq") % n)
    for b in range(n):
        df.where(F.col("__b") == b).drop("__b").coalesce(1).write.mode("append").parquet(path)


def test_stream_fold_equals_batch(spark):
    ch = _changes(spark)
    base = tempfile.mkdtemp(prefix="w11-", dir="/tmp")
    src = os.path.join(base, "src")
    _write_files(ch, src, 5)
    q = (fold_stream(change_source(spark, src, max_files_per_trigger=1))
         .writeStream.format("memory").queryName("w11_fold").outputMode("complete")
         .option("checkpointLocation", os.path.join(base, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    streamed = spark.table("w11_fold")
    batch = CH.fold_changes(ch)
    assert streamed.count() == batch.count() == 6
    assert streamed.exceptAll(batch.select(streamed.columns)).count() == 0
    assert q.lastProgress is not None


def test_apply_change_stream(spark, demo):
    ch = _changes(spark)
    base = tempfile.mkdtemp(prefix="w11a-", dir="/tmp")
    src = os.path.join(base, "src")
    _write_files(ch, src, 4)
    q = apply_change_stream(change_source(spark, src, max_files_per_trigger=1), demo,
                            os.path.join(base, "out"), os.path.join(base, "ckpt"), T)
    q.awaitTermination(180)
    final = spark.read.parquet(latest_version(os.path.join(base, "out"), "customers"))
    want, _ = CH.apply_folded(demo, CH.fold_changes(ch), "customers", T)
    want = want["customers"]
    assert final.count() == want.count()
    assert final.exceptAll(want.select(final.columns)).count() == 0


def test_apply_change_stream_bucketed(spark, demo):
    from halyard.streaming.change_stream import read_bucketed
    ch = _changes(spark)
    base = tempfile.mkdtemp(prefix="w11b-", dir="/tmp")
    src = os.path.join(base, "src")
    _write_files(ch, src, 4)
    out = os.path.join(base, "out")
    q = apply_change_stream(change_source(spark, src, max_files_per_trigger=1), demo, out,
                            os.path.join(base, "ckpt"), T, buckets=4)
    q.awaitTermination(300)
    assert q.exception() is None
    final = read_bucketed(spark, out, "customers")
    want, _ = CH.apply_folded(demo, CH.fold_changes(ch), "customers", T)
    want = want["customers"]
    assert final.count() == want.count() == 5
    assert final.exceptAll(want.select(final.columns)).count() == 0


def test_bucketed_stream_clears_an_emptied_bucket(spark, demo):
    from halyard.streaming.change_stream import BUCKET, read_bucketed
    rows = [(1, None, 2, "delete", False, None, False, None),
            (2, None, 5, "delete", False, None, False, None),   # ids 2 and 5 share a bucket
            (3, None, 1, "patch", True, "churned", False, None)]
    ch = spark.createDataFrame(rows, S.CUSTOMER_CHANGES)
    base = tempfile.mkdtemp(prefix="w11e-", dir="/tmp")
    src = os.path.join(base, "src")
    _write_files(ch, src, 1)
    out = os.path.join(base, "out")
    q = apply_change_stream(change_source(spark, src), demo, out, os.path.join(base, "ckpt"),
                            T, buckets=4)
    q.awaitTermination(300)
    final = read_bucketed(spark, out, "customers")
    assert sorted(r["id"] for r in final.collect()) == [1, 3, 4, 6]
    assert final.where("id = 1").first()["status"] == "churned"
    assert not os.path.exists(os.path.join(out, "customers", f"{BUCKET}=1"))


def test_bucketed_apply_reads_only_touched_buckets(spark, demo, tmp_path):
    from halyard.streaming.change_stream import BUCKET, id_bucket, read_bucketed

    rows = demo["customers"]
    path = str(tmp_path / "t")
    rows.withColumn(BUCKET, id_bucket(4)).write.partitionBy(BUCKET).parquet(path + "/customers")
    plan = read_bucketed(spark, path, "customers", [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and BUCKET in plan.split("PartitionFilters:")[1].split("]")[0]


def _run_deletes(spark, demo, tmp_path, **options):
    """Customer 1 deleted, 3 patched, 4 patched with an unknown status."""
    rows = [(1, None, 1, "delete", False, None, False, None),
            (2, None, 3, "patch", True, "churned", False, None),
            (3, None, 4, "patch", True, "bogus", False, None)]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _write_files(spark.createDataFrame(rows, S.CUSTOMER_CHANGES), src, 1)
    q = apply_change_stream(change_source(spark, src), demo, out, str(tmp_path / "ckpt"), T, **options)
    q.awaitTermination(300)
    assert q.exception() is None
    return out


def _check_children(demo, subs, log):
    gone = {r["id"] for r in demo["customer_packages"].where("customer_id = 1").collect()}
    assert gone
    assert sorted(r["id"] for r in subs.collect()) == sorted(
        r["id"] for r in demo["customer_packages"].where("customer_id <> 1").collect())
    want = ((r["id"], None if r["customer_id"] == 1 else r["customer_id"],
             None if r["customer_package_id"] in gone else r["customer_package_id"])
            for r in demo["notification_log"].collect())
    want = sorted(want, key=lambda x: x[0])
    assert sorted(((r["id"], r["customer_id"], r["customer_package_id"]) for r in log.collect()),
                  key=lambda x: x[0]) == want


def test_streamed_delete_reaches_the_children(spark, demo, tmp_path):
    from halyard.sources import tables as TB
    # An older, higher version than batch 0 must not go on being served.
    out = str(tmp_path / "out")
    TB.write_table(demo["customers"], out, "customers", 7)
    assert _run_deletes(spark, demo, tmp_path) == out
    read = lambda n: spark.read.parquet(latest_version(out, n))
    assert latest_version(out, "customers").endswith("v=8")
    assert sorted(r["id"] for r in read("customers").collect()) == [2, 3, 4, 5, 6]
    _check_children(demo, read("customer_packages"), read("notification_log"))
    assert sorted(tuple(r) for r in read("customers_outcomes").collect()) == [
        (1, "deleted"), (3, "updated"), (4, "rejected")]
    assert TB.last_issued_id(spark, out, "customers") == 6


def test_streamed_delete_reaches_the_children_bucketed(spark, demo, tmp_path):
    from halyard.streaming.change_stream import read_bucketed
    out = _run_deletes(spark, demo, tmp_path, buckets=4)
    assert sorted(r["id"] for r in read_bucketed(spark, out, "customers").collect()) == [2, 3, 4, 5, 6]
    _check_children(demo, read_bucketed(spark, out, "customer_packages"),
                    read_bucketed(spark, out, "notification_log"))
    assert sorted(tuple(r) for r in spark.read.parquet(latest_version(out, "customers_outcomes")).collect()) == [
        (1, "deleted"), (3, "updated"), (4, "rejected")]


def test_bucketed_stream_checks_keys_of_other_buckets(spark, tmp_path):
    """An e-mail held by a row of a bucket that the batch does not touch."""
    from tests.demo_rows import demo_tables
    from tests.test_replay import people
    t = {**demo_tables(spark), "customers": people(spark, 40)}
    rows = [(k, k, "patch", True, f"u{39 - k}@example.com") for k in range(3)] + [(3, 3, "patch", True, "free@example.com")]
    frame = spark.createDataFrame(rows, "seq bigint, id bigint, op string, set_email boolean, email string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = apply_change_stream(change_source(spark, str(tmp_path / "in"), frame.schema), t, out, str(tmp_path / "state"), T, buckets=16)
    query.awaitTermination()
    assert query.exception() is None
    got = {r["id"]: r["email"] for r in read_bucketed(spark, out, "customers").collect()}
    assert got == {k: "free@example.com" if k == 3 else f"u{k}@example.com" for k in range(40)}
    outcomes = {r["id"]: r["outcome"] for r in spark.read.parquet(latest_version(out, "customers_outcomes")).collect()}
    assert outcomes == {0: "rejected", 1: "rejected", 2: "rejected", 3: "updated"}


def test_scratch_tables_are_removed_after_each_batch(spark, tmp_path):
    import os

    from halyard.session import ensure_checkpoint_dir, pinned, scratch_scope
    base = os.path.join(ensure_checkpoint_dir(spark), "tables")
    with scratch_scope(spark) as paths:
        df = pinned(spark.range(5), "scoped")
        assert df.count() == 5 and len(paths) == 1 and os.path.exists(paths[0])
    assert not os.path.exists(paths[0])
    kept = pinned(spark.range(3), "unscoped")
    assert kept.count() == 3 and os.path.isdir(base)
