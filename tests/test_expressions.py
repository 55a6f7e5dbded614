"""Scalar expressions E1-E16 on hand-made values."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from halyard.functions import expressions as E
from halyard.functions.time import horizon_interval
from tests.demo_rows import T


def one(spark, col, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_days_left_and_until_half_days(spark):
    data = [(T + dt.timedelta(days=2.5),), (T - dt.timedelta(days=2.5),), (T,), (None,)]
    left = one(spark, E.days_left("e", T).cast("int"), data, "e timestamp_ntz")
    until = one(spark, E.days_until("e", T), data, "e timestamp_ntz")
    assert left == [2, -2, 0, None]
    assert until == [3, -2, 0, None]


def test_bands_and_relative(spark):
    data = [(-3,), (0,), (7,), (8,), (None,)]
    assert one(spark, E.expiry_band("x"), data, "x int") == \
        ["expired", "expiring_soon", "expiring_soon", "ok", None]
    assert one(spark, E.relative_expiry("x"), data, "x int") == \
        ["3d ago", "in 0d", "in 7d", "in 8d", None]
    assert one(spark, E.dashboard_urgency("x"), data, "x int") == \
        ["urgent", "urgent", "urgent", "warning", None]
    assert one(spark, E.mail_urgency("x"), [(2,), (3,)], "x int") == ["urgent", "warning"]


def test_promotion_status(spark):
    data = [(False, T), (True, T - dt.timedelta(seconds=1)), (True, T)]
    assert one(spark, E.promotion_status("a", "v", T), data, "a boolean, v timestamp_ntz") == \
        ["Inactive", "Expired", "Active"]


def test_discount_label_and_numbers(spark):
    data = [(Decimal("20.00"), None), (None, Decimal("10.50")),
            (Decimal("12.50"), Decimal("5.00")), (None, None)]
    assert one(spark, E.discount_label("p", "a"), data, "p decimal(5,2), a decimal(10,2)") == \
        ["20%", "$10.5", "12.5% / $5", "—"]


def test_features(spark):
    data = [(" a ,b,, \tc ",), ("",), (None,)]
    assert one(spark, E.features_parse("t"), data, "t string") == [["a", "b", "c"], [], []]
    assert one(spark, E.features_text("f"), [(["a", "b"],), (None,)], "f array<string>") == \
        ["a, b", ""]


def test_price_revenue_escape(spark):
    assert one(spark, E.price_text("p"), [(Decimal("0.00"),), (None,), (Decimal("79.00"),)],
               "p decimal(10,2)") == ["$0.00", "—", "$79.00"]
    assert one(spark, E.revenue_text("p"), [(Decimal("1234567.50"),)], "p decimal(20,2)") == \
        ["1,234,567.50"]
    assert one(spark, E.html_escape("s"), [("a<b>&c",)], "s string") == ["a&lt;b&gt;&amp;c"]


def test_default_expiry_and_horizon(spark):
    assert one(spark, E.default_expiry("n", T), [(10,), (None,)], "n int") == \
        [dt.datetime(2001, 8, 11), dt.datetime(2001, 8, 31)]
    assert one(spark, F.col("t") + horizon_interval(2.5), [(T,)], "t timestamp_ntz") == \
        [T + dt.timedelta(days=2.5)]
    assert one(spark, F.col("t") + horizon_interval(F.col("n") / F.lit(8)), [(T, 3)],
               "t timestamp_ntz, n int") == [T + dt.timedelta(days=3 / 8)]
