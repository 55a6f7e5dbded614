"""Both or neither: several tables written, one commit record."""

import datetime as dt

import pytest

from halyard.operators import changes as CH
from halyard.sources import schemas as S
from halyard.sources import tables as TB
from halyard.streaming.change_stream import replay_change_stream
from tests.test_replay import SCHEMA, change, people, plain_replay

T = dt.datetime(2024, 6, 1)


def published(spark, demo, path):
    TB.publish(spark, path, {n: demo[n] for n in S.TABLES})


def nested_create(spark, t):
    rows = spark.createDataFrame(
        [(1, "New", "One", "new1@x.org", (1, None, None, "2024-07-01T00:00:00Z", 5.0)), (2, "New", "Two", "new2@x.org", None)],
        "row_id bigint, first_name string, last_name string, email string, "
        "subscription struct<package_id:bigint,promotion_id:bigint,joined_at:string,expires_at:string,price_paid:double>")
    customers, subs, _ = CH.create_with_subscription(t, rows, T)
    return {"customers": t["customers"].unionByName(customers.drop("row_id")),
            "customer_packages": t["customer_packages"].unionByName(subs.drop("row_id"))}


def state(spark, path):
    t = TB.load_tables(spark, path)
    return {n: sorted(map(str, t[n].collect())) for n in S.TABLES}


@pytest.mark.parametrize("cut", [0, 1, 2])
def test_a_write_cut_short_shows_the_old_state(spark, demo, tmp_path, monkeypatch, cut):
    """Cut before the first table, between the two, and before the record."""
    path = str(tmp_path)
    published(spark, demo, path)
    before = state(spark, path)
    t = TB.load_tables(spark, path)
    new = nested_create(spark, t)
    calls = []

    def write(*args, **kw):
        if len(calls) == cut:
            raise OSError("lost")
        calls.append(args[2])
        return real(*args, **kw)

    def record(*args, **kw):
        raise OSError("lost")

    real = TB.write_table
    with monkeypatch.context() as m:
        m.setattr(TB, "write_table", write)
        m.setattr(TB, "write_commit", record)
        with pytest.raises(OSError):
            TB.publish(spark, path, new)
    assert len(calls) == cut and state(spark, path) == before
    assert TB.publish(spark, path, new) == 2
    after = state(spark, path)
    assert len(after["customers"]) == len(before["customers"]) + 2
    assert len(after["customer_packages"]) == len(before["customer_packages"]) + 1
    assert {n: after[n] for n in S.TABLES if n not in new} == {n: before[n] for n in S.TABLES if n not in new}


def test_a_record_that_is_not_whole_is_not_seen(spark, demo, tmp_path):
    path = str(tmp_path)
    published(spark, demo, path)
    TB.write_table(demo["customers"].limit(1), path, "customers", 7)
    (tmp_path / TB.COMMITS / "c=5").write_text("customers=7\n")
    assert TB.current_commit(spark, path)[0] == 1
    assert TB.load_tables(spark, path)["customers"].count() == demo["customers"].count()


def test_two_writers_that_start_together(spark, demo, tmp_path):
    path = str(tmp_path)
    published(spark, demo, path)
    base = TB.current_commit(spark, path)[0]
    t = TB.load_tables(spark, path)
    one, two = nested_create(spark, t), nested_create(spark, t)
    assert TB.publish(spark, path, one, base=base) == base + 1
    with pytest.raises(TB.CommitConflict):
        TB.publish(spark, path, two, base=base)
    with pytest.raises(TB.CommitConflict):  # both passed the check, one record was first
        TB.write_commit(spark, path, base + 1, {"customers": 9})
    ids = [r["id"] for r in TB.load_tables(spark, path)["customers"].collect()]
    assert len(ids) == len(set(ids)) == demo["customers"].count() + 2
    again = nested_create(spark, TB.load_tables(spark, path))["customers"]
    assert again.count() == len(ids)  # the addresses are taken now


def test_streamed_replay_over_micro_batches(spark, demo, tmp_path):
    """Each file is a micro-batch, applied to what the last one published."""
    customers = people(spark, 8)
    mail = lambda k: f"u{k}@example.com"
    feeds = [[change(1, 0, email="new@example.com"), change(2, 1, email=mail(2)), change(3, 3, op="delete")],
             [change(4, 2, email="two@example.com"), change(5, 1, email=mail(2)), change(6, 4, email=mail(0)), change(7, 3, notes="x")],
             [change(8, 5, email=mail(0)), change(9, 6, email=mail(3)), change(10, 4, email="gone@example.com"), change(11, 5, email=mail(0))]]
    source = str(tmp_path / "in")
    for k, rows in enumerate(feeds):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    t = {**demo, "customers": customers}
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = replay_change_stream(stream, t, out, str(tmp_path / "state"), T, trigger={"availableNow": True})
    query.awaitTermination()
    assert query.exception() is None
    companies = {r["id"] for r in demo["companies"].collect()}
    rows, want = plain_replay(customers.collect(), companies, [c for f in feeds for c in f])
    outcomes = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/customers_outcomes").collect()
    assert {r["seq"]: r["outcome"] for r in outcomes} == want and len(outcomes) == len(want)
    number, versions = TB.current_commit(spark, out)
    got = TB.load_table(spark, out, "customers", version=versions["customers"])
    assert {r["id"]: r.asDict() for r in got.collect()} == rows
