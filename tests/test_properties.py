"""
generated values."""

import glob
import os
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.functions import expressions as E
from halyard.operators import lifecycle as L
from halyard.operators import metrics as M
from halyard.operators import validation as VAL
from halyard.operators import views as V
from halyard.session import AS_OF
from halyard.sources.fixtures import fixture_tables, overlay

SF = "/root/testdata/sf0.01"


def same(a, b) -> bool:
    return a.count() == b.count() and a.exceptAll(b.select(a.columns)).count() == 0


def test_auto_expire_idempotent_and_keeps_expiring(spark):
    t = fixture_tables(spark, SF)
    once = L.auto_expire(t["customer_packages"], AS_OF)
    twice = L.auto_expire(once, AS_OF)
    assert same(once, twice)
    # W1 then F7 equals F7: nothing W1 touches can be expiring.
    after = V.expiring_within(overlay(t, customer_packages=once), 30, AS_OF)
    assert same(after, V.expiring_within(t, 30, AS_OF))


def test_counts_add_up(spark):
    t = fixture_tables(spark, SF)
    total = M.customer_count(t).agg(F.sum("customer_count")).first()[0]
    with_company = t["customers"].where("company_id IS NOT NULL").count()
    assert total == with_company
    s = M.dashboard_stats(t, AS_OF).first()
    cancelled = t["customer_packages"].where("status = 'cancelled'").count()
    assert s["active_subscriptions"] + s["expired_subscriptions"] + cancelled == \
        t["customer_packages"].count()


def test_valid_plus_rejected_is_input(spark):
    t = fixture_tables(spark, SF)
    for entity, view in [("customers", "dirty_customers"), ("customer_packages", "dirty_subscriptions"),
                         ("companies", "dirty_companies"), ("packages", "dirty_packages"),
                         ("promotions", "dirty_promotions")]:
        valid, rejected = VAL.VALIDATORS[entity](t[view])
        assert valid.count() + rejected.count() == t[view].count()
        assert rejected.where(F.size("errors") == 0).count() == 0


def test_digest_sink_writes_lines_in_order(spark):
    t = fixture_tables(spark, SF)
    cand = V.reminder_candidates(t, 30, AS_OF)
    path = os.path.join(tempfile.mkdtemp(prefix="digest-", dir="/tmp"), "text")
    L.write_digest(L.digest_lines(cand, 30), path)
    body = []
    for f in sorted(glob.glob(os.path.join(path, "part-*"))):
        body += open(f, encoding="utf-8").read().splitlines()
    n = cand.count()
    assert len(body) == n + 4
    assert body[0] == f"⚠️ CRM Alert: {n} subscription(s) expiring within 30 days"
    assert body[-1] == L.SIGN_OFF
    dates = [ln.split(" — expires ")[1][:10] for ln in body[2:-2]]
    assert dates == sorted(dates)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=" \t,ab", max_size=12), max_size=6))
def test_features_parse_matches_python(spark, parts):
    text = ",".join(parts)
    want = [p.strip() for p in text.split(",") if p.strip()]
    got = spark.createDataFrame([(text,)], "t string").select(E.features_parse("t")).first()[0]
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.integers(min_value=-10**6, max_value=10**6))
def test_day_counts_match_python(spark, seconds):
    import datetime as dt
    import math
    e = AS_OF + dt.timedelta(seconds=seconds)
    row = spark.createDataFrame([(e,)], "e timestamp_ntz").select(
        E.days_left("e", AS_OF).cast("int"), E.days_until("e", AS_OF)).first()
    assert row[0] == int(seconds / 86400)
    assert row[1] == math.ceil(seconds / 86400)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=20), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=9), st.integers(min_value=0, max_value=10**6))
def test_assign_ids_equal_row_number(spark, keys, partitions, start):
    from pyspark.sql import Window
    from halyard.operators.ids import assign_ids
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, seq int")
    want = df.select("k", "seq", (F.row_number().over(Window.orderBy("k", "seq")) + start)
                     .cast("bigint").alias("id"))
    for got in (assign_ids(df, start, ["k", "seq"], partitions=partitions),
                assign_ids(df, start, ["k", "seq"])):
        assert sorted(map(tuple, got.select("k", "seq", "id").collect())) == \
            sorted(map(tuple, want.collect()))


def _search_model(term: str, text: str) -> bool:
    """The search semantics in plain Python: ``%`` any run, ``_`` any one
    character, backslash escapes the next character (a trailing one is
    literal), case-insensitive substring."""
    import re
    out, i = [], 0
    while i < len(term):
        ch = term[i]
        if ch == "\\":
            out.append(re.escape(term[i + 1]) if i + 1 < len(term) else re.escape("\\"))
            i += 2
            continue
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
        i += 1
    return re.fullmatch(".*" + "".join(out) + ".*", text, re.IGNORECASE | re.DOTALL) is not None


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="aB%_\\", min_size=1, max_size=5),
       st.lists(st.text(alphabet="abAB%_\\", max_size=6), min_size=1, max_size=8))
def test_search_matches_model(spark, term, names):
    df = spark.createDataFrame([(i, n, "x", "x@y.zz") for i, n in enumerate(names)],
                               "id int, first_name string, last_name string, email string")
    got = sorted(r["id"] for r in V.filter_customers(df, search=term).collect())
    want = sorted(i for i, n in enumerate(names)
                  if _search_model(term, n) or _search_model(term, "x")
                  or _search_model(term, "x@y.zz"))
    assert got == want
