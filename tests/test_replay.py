"""W5 and W11 against a plain replay, one change after the other."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from halyard.operators import changes as CH
from halyard.operators import claims as CL
from halyard.operators import replay as RP
from halyard.operators.claims import resolve_claims
from halyard.operators.replay import replay_changes
from halyard.sources import schemas as S
from halyard.sources.fixtures import overlay
from halyard.streaming.change_stream import change_source, replay_change_stream

T = dt.datetime(2024, 6, 1)
SCHEMA = ("seq bigint, id bigint, op string, set_email boolean, email string, set_status boolean, status string, "
          "set_company_id boolean, company_id bigint, set_notes boolean, notes string")


def change(seq, id_, op="patch", **fields):
    row = [seq, id_, op]
    for f in ("email", "status", "company_id", "notes"):
        row += [f in fields, fields.get(f)]
    return tuple(row)


def plain_replay(customers, companies, changes):
    """(rows by id, outcomes by seq): dictionaries changed one by one."""
    rows, out, touched = {r["id"]: r.asDict() for r in customers}, {}, set()
    for c in sorted(changes, key=lambda c: c[0]):
        seq, id_, op = c[:3]
        values = {f: v for f, has, v in zip(("email", "status", "company_id", "notes"), c[3::2], c[4::2]) if has}
        if op == "delete":
            out[seq] = "deleted" if rows.pop(id_, None) else "not_found"
            continue
        bad = (not values or "email" in values and (values["email"] is None or "@" not in values["email"])
               or "status" in values and values["status"] not in ("active", "inactive", "churned"))
        if bad:
            out[seq] = "rejected"
        elif id_ not in rows:
            out[seq] = "not_found"
        elif values.get("company_id") not in companies | {None} or any(
                j != id_ and r["email"] == values.get("email") for j, r in rows.items()):
            out[seq] = "rejected"
        else:
            rows[id_].update(values)
            touched.add(id_)
            out[seq] = "updated"
    for i in touched & set(rows):
        rows[i]["updated_at"] = T
    return rows, out


def people(spark, n):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, f"F{i}", f"L{i}", f"u{i}@example.com", None, None, "active", None, t, t) for i in range(n)]
    return spark.createDataFrame(rows, S.CUSTOMERS)


def check(spark, demo, n, changes):
    customers = people(spark, n)
    t = overlay(demo, customers=customers)
    frame = spark.createDataFrame(changes, SCHEMA)
    new, outcomes = replay_changes(t, frame, "customers", T)
    companies = {r["id"] for r in demo["companies"].collect()}
    rows, want = plain_replay(customers.collect(), companies, changes)
    got = {r["seq"]: r["outcome"] for r in outcomes.collect()}
    assert got == want
    assert {r["id"]: r.asDict() for r in new["customers"].collect()} == rows
    return {r["seq"]: r["errors"] for r in outcomes.collect()}


def test_freed_swapped_chained_contested(spark, demo):
    mail = lambda k: f"u{k}@example.com"
    changes = [
        change(1, 0, email="new@example.com"), change(2, 1, email=mail(0)),      # freed by a patch
        change(3, 2, op="delete"), change(4, 3, email=mail(2)),                  # freed by a delete
        change(5, 4, email=mail(5)), change(6, 5, email=mail(4)),                # a swap: neither is free
        change(7, 6, email="tmp@example.com"), change(8, 7, email=mail(6)), change(9, 6, email=mail(7)),   # a swap by a third
        change(10, 8, email=mail(9)),                                            # refused ...
        change(11, 10, email=mail(8)),                                           # ... so this is, too
        change(12, 12, email="hot@example.com"), change(13, 11, email="hot@example.com"),
        change(14, 12, email=mail(12)), change(15, 11, email="hot@example.com"),  # given back, taken later
        change(16, 2, status="inactive"), change(17, 2, op="delete"), change(18, 99, notes="x"),
        change(19, 13, email=mail(13)), change(20, 13, email="no mail", notes="lost"), change(21, 13),
        change(22, 14, company_id=1), change(23, 14, company_id=999, notes="lost"), change(24, 14, status="bogus"),
        change(25, 15, email="x@example.com", status="churned"), change(26, 15, email=mail(14), notes="lost")]
    errors = check(spark, demo, 16, changes)
    assert errors[5] == errors[13] == errors[26] == "unique:email" and errors[23] == "company_id:no_parent"
    assert errors[20] == "email:email" and errors[21] == "no_fields" and errors[1] == errors[16] == ""


def random_feed(r, n, size, hot_mail=0.3, hot_id=0.2):
    out = []
    for seq in range(1, size + 1):
        id_ = 1 if r.random() < hot_id else r.randrange(n + 3)
        kind = r.random()
        mail = "hot@example.com" if r.random() < hot_mail else f"u{r.randrange(n)}@example.com"
        if kind < 0.08:
            out.append(change(seq, id_, op="delete") if id_ != 1 else change(seq, id_, notes=f"n{seq}"))
        elif kind < 0.75:
            out.append(change(seq, id_, email=mail, notes=f"n{seq}"))
        elif kind < 0.85:
            out.append(change(seq, id_, status=r.choice(["active", "churned", "bogus", None])))
        else:
            out.append(change(seq, id_, company_id=r.choice([1, 2, None, 77])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_feeds(spark, demo, seed):
    r = random.Random(seed)
    check(spark, demo, 12, random_feed(r, 12, 150))


def test_hot_key_and_hot_id_span_partitions(spark, demo):
    """A key and an id that hold most events lie in several range partitions;
    the carried totals give the replay's result."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        check(spark, demo, 30, random_feed(random.Random(5), 30, 300, hot_mail=0.6, hot_id=0.5))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_chain_of_refusals(spark):
    """Each claim asks for the key of the next row; the last one cannot move,
    so all are refused, one round after the other."""
    n = 6
    rows = [(k, None, f"k{k}", "hold") for k in range(n + 1)] + [(k, n - k, f"k{k + 1}", "claim") for k in range(n)]
    got = resolve_claims(spark.createDataFrame(rows, "id bigint, seq bigint, key string, kind string"))
    assert {r["seq"]: r["stands"] for r in got.collect()} == {k: False for k in range(1, n + 1)}
    rows.append((n, 0, "free", "claim"))
    got = resolve_claims(spark.createDataFrame(rows, "id bigint, seq bigint, key string, kind string"))
    assert all(r["stands"] for r in got.collect())


def test_a_long_chain_takes_few_writes(spark, monkeypatch):
    """Sixty refusals that follow from each other are replayed at one go."""
    n, written, pinned = 60, [], CL.pinned
    monkeypatch.setattr(CL, "pinned", lambda df, name: written.append(name) or pinned(df, name))
    rows = [(k, None, f"k{k}", "hold") for k in range(n + 1)] + [(k, n - k, f"k{k + 1}", "claim") for k in range(n)]
    got = resolve_claims(spark.createDataFrame(rows, "id bigint, seq bigint, key string, kind string"))
    assert {r["seq"]: r["stands"] for r in got.collect()} == {k: False for k in range(1, n + 1)}
    assert len(written) < 12


def chained_feed(n):
    """Each customer asks for the address of the next one; the last cannot
    move in the first half, and moves first in the second."""
    mail = lambda k: f"u{k}@example.com"
    asks = lambda at: [change(at + n - k, k, email=mail(k + 1), notes=f"n{at}") for k in range(n)]
    return asks(0) + [change(n + 1, n, email="free@example.com")] + asks(n + 1)


def test_tables_after_a_long_chain(spark, demo, monkeypatch):
    n, written, pinned = 50, [], CL.pinned
    monkeypatch.setattr(CL, "pinned", lambda df, name: written.append(name) or pinned(df, name))
    errors = check(spark, demo, n + 1, chained_feed(n))
    assert [errors[s] for s in (1, n, n + 1, n + 2, 2 * n + 1)] == ["unique:email"] * 2 + [""] * 3
    assert len(written) < 12


def test_a_replay_writes_and_measures_little(spark, demo, monkeypatch):
    """The changes are measured once; one segment takes six writes."""
    written, measured, pinned, is_small = [], [], CL.pinned, RP.is_small
    monkeypatch.setattr(CL, "pinned", lambda df, name: written.append(name) or pinned(df, name))
    monkeypatch.setattr(RP, "is_small", lambda df: measured.append(df) or is_small(df))
    check(spark, demo, 11, chained_feed(10))
    assert len(written) == 6 and len(measured) == 1


def test_a_long_chain_as_a_stream(spark, demo, monkeypatch, tmp_path):
    """The chain of one micro-batch takes few writes, too."""
    n, written, pinned = 50, [], CL.pinned
    monkeypatch.setattr(CL, "pinned", lambda df, name: written.append(name) or pinned(df, name))
    customers, feed = people(spark, n + 1), spark.createDataFrame(chained_feed(n), SCHEMA)
    feed.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = replay_change_stream(change_source(spark, str(tmp_path / "in"), feed.schema), overlay(demo, customers=customers),
                                 str(tmp_path / "out"), str(tmp_path / "state"), T)
    query.awaitTermination()
    assert query.exception() is None and len(written) < 12
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / "customers_outcomes"))
    _, want = plain_replay(customers.collect(), {r["id"] for r in demo["companies"].collect()}, chained_feed(n))
    assert {r["seq"]: r["outcome"] for r in got.collect()} == want


@pytest.mark.parametrize("seed, hot_mail, hot_id", [(3, 0.3, 0.2), (4, 0.6, 0.5)])
def test_replay_over_many_segments(spark, demo, monkeypatch, seed, hot_mail, hot_id):
    """What a segment leaves is carried to those behind it."""
    monkeypatch.setattr(CL, "SEGMENT_ROWS", 25)
    check(spark, demo, 20, random_feed(random.Random(seed), 20, 300, hot_mail, hot_id))


def test_chain_of_refusals_over_segments(spark, monkeypatch):
    monkeypatch.setattr(CL, "SEGMENT_ROWS", 3)
    test_chain_of_refusals(spark)


def test_a_micro_batch_is_written_once(spark, demo, monkeypatch, tmp_path):
    written, pinned = [], RP.pinned
    monkeypatch.setattr(RP, "pinned", lambda df, name: written.append(name) or pinned(df, name))
    customers, feed = people(spark, 6), spark.createDataFrame(chained_feed(5), SCHEMA)
    feed.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = replay_change_stream(change_source(spark, str(tmp_path / "in"), feed.schema), overlay(demo, customers=customers),
                                 str(tmp_path / "out"), str(tmp_path / "state"), T)
    query.awaitTermination()
    assert query.exception() is None and written and "replay-changes" not in written
    rows, _ = plain_replay(customers.collect(), {r["id"] for r in demo["companies"].collect()}, chained_feed(5))
    got = spark.read.schema(S.CUSTOMERS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / "customers"))
    assert {r["id"]: r.asDict() for r in got.collect()} == rows


def test_more_segments_than_sequences(spark, monkeypatch):
    """Repeated claims fill one segment; others have no event."""
    monkeypatch.setattr(CL, "SEGMENT_ROWS", 1)
    test_repeated_events_and_two_holders_of_a_key(spark)


def test_repeated_events_and_two_holders_of_a_key(spark):
    """Repeated holds and claims have a row each; a key with two holders is
    free when both gave it up."""
    rows = [(1, None, "a", "hold"), (1, None, "a", "hold"), (2, None, "a", "hold"), (3, None, "c", "hold"),
            (3, 1, "a", "claim"), (1, 2, "b", "claim"), (1, 2, "b", "claim"), (3, 3, "a", "claim"),
            (2, 4, None, "free"), (3, 5, "a", "claim"), (3, 5, "a", "claim"), (1, 6, "c", "claim")]
    got = resolve_claims(spark.createDataFrame(rows, "id bigint, seq bigint, key string, kind string"))
    assert sorted((r["seq"], r["stands"]) for r in got.collect()) == [
        (1, False), (2, True), (2, True), (3, False), (5, True), (5, True), (6, True)]


def test_empty_batches_and_changes_without_place(spark, demo):
    none = spark.createDataFrame([], SCHEMA)
    new, out = replay_changes(demo, none, "customers", T)
    assert out.count() == 0 and new["customers"].count() == demo["customers"].count()
    lost = [change(None, 1, notes="a"), change(1, None, notes="b"), change(2, 1, op="upsert", notes="c")]
    new, out = replay_changes(demo, spark.createDataFrame(lost, SCHEMA), "customers", T)
    assert {r["errors"] for r in out.collect()} == {"seq:required", "id:required", "op:unknown"}
    assert {r["outcome"] for r in out.collect()} == {"rejected"}
    assert new["customers"].exceptAll(demo["customers"]).count() == 0


def test_deletes_reach_the_children_and_restricted_ones_stay(spark, demo):
    new, out = replay_changes(demo, spark.createDataFrame(
        [change(1, 2, op="delete"), change(2, 2, notes="late")], SCHEMA), "customers", T)
    assert [r["outcome"] for r in out.orderBy("seq").collect()] == ["deleted", "not_found"]
    assert new["customer_packages"].where("customer_id = 2").count() == 0
    ch = spark.createDataFrame([(1, 1, "patch", True, "One"), (2, 1, "delete", False, None), (3, 1, "patch", True, "Two")],
                               "seq bigint, id bigint, op string, set_name boolean, name string")
    new, out = replay_changes(demo, ch, "packages", T)
    assert [r["outcome"] for r in out.orderBy("seq").collect()] == ["updated", "restricted", "updated"]
    assert new["packages"].where("id = 1").first()["name"] == "Two"


def test_contested_key_goes_to_the_first_by_sequence(spark, demo):
    p = spark.createDataFrame([change(2, 1, email="one@x.org"), change(1, 3, email="one@x.org")], SCHEMA)
    new, out = CH.patch_batch(demo, p, "customers", T)
    assert {r["seq"]: r["outcome"] for r in out.collect()} == {1: "updated", 2: "rejected"}
    assert new.where(F.col("email") == "one@x.org").first()["id"] == 3
