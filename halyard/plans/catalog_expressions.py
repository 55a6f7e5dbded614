"""Registered scalar expressions (E1-E16), each applied across its view."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.functions import expressions as E
from halyard.functions.time import horizon_interval
from halyard.operators import views as V
from halyard.operators.joins import small_side
from halyard.plans.catalog import AS_OF, register

DAYS_LEFT_SQL = "CAST(trunc(epoch(expires_at - {AS_OF}) / 86400) AS INTEGER)"
DAYS_UNTIL_SQL = ("CAST(ceil(date_diff('microsecond', {AS_OF}, expires_at) / 86400000000.0) "
                  "AS INTEGER)")
CUR_SQL = """
WITH cur AS (SELECT * EXCLUDE (rn) FROM (
          SELECT cp.*, row_number() OVER (PARTITION BY customer_id
                                          ORDER BY expires_at DESC, id DESC) AS rn
          FROM customer_packages cp WHERE status = 'active') WHERE rn = 1),
d AS (SELECT c.id, """ + DAYS_UNTIL_SQL.replace("expires_at", "cur.expires_at") + """ AS days
      FROM customers c LEFT JOIN cur ON cur.customer_id = c.id)
"""


def esc_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _current_days(t):
    v = V.customer_360(t)
    return v.select("id", E.days_until("expires_at", AS_OF).alias("days"))


@register("full_name", "SELECT id, first_name || ' ' || last_name AS full_name FROM customers")
def _full_name(t):
    """E1 over customers."""
    return t["customers"].select("id", E.full_name("first_name", "last_name").alias("full_name"))


@register("days_left", f"SELECT id, {DAYS_LEFT_SQL} AS days_left FROM customer_packages")
def _days_left(t):
    """E2 over subscriptions: whole days to expiry, truncated."""
    return t["customer_packages"].select(
        "id", E.days_left("expires_at", AS_OF).cast("int").alias("days_left"))


@register("days_until", f"SELECT id, {DAYS_UNTIL_SQL} AS days_until FROM customer_packages")
def _days_until(t):
    """E3 over subscriptions: days to expiry, rounded up."""
    return t["customer_packages"].select("id", E.days_until("expires_at", AS_OF).alias("days_until"))


@register("expiry_band", CUR_SQL + """
SELECT id, CASE WHEN days IS NULL THEN NULL WHEN days < 0 THEN 'expired'
                WHEN days <= 7 THEN 'expiring_soon' ELSE 'ok' END AS expiry_band FROM d""")
def _expiry_band(t):
    """E4 over each customer's current subscription (NULL when none)."""
    return _current_days(t).select("id", E.expiry_band("days").alias("expiry_band"))


@register("urgency", f"""
SELECT id, CASE WHEN {DAYS_UNTIL_SQL} <= 7 THEN 'urgent' ELSE 'warning' END AS screen_urgency,
       CASE WHEN {DAYS_LEFT_SQL} <= 2 THEN 'urgent' ELSE 'warning' END AS mail_urgency
FROM customer_packages""")
def _urgency(t):
    """E5, both variants, over subscriptions."""
    cp = t["customer_packages"]
    return cp.select("id", E.dashboard_urgency(E.days_until("expires_at", AS_OF))
                     .alias("screen_urgency"),
                     E.mail_urgency(E.days_left("expires_at", AS_OF)).alias("mail_urgency"))


@register("relative_expiry", CUR_SQL + """
SELECT id, CASE WHEN days < 0 THEN CAST(-days AS VARCHAR) || 'd ago'
                WHEN days IS NOT NULL THEN 'in ' || CAST(days AS VARCHAR) || 'd' END
       AS relative_expiry FROM d""")
def _relative_expiry(t):
    """E6 over each customer's current subscription."""
    return _current_days(t).select("id", E.relative_expiry("days").alias("relative_expiry"))


@register("promotion_status", """
SELECT cp.id, CASE WHEN NOT pr.active THEN 'Inactive' WHEN pr.valid_until < {AS_OF} THEN 'Expired'
                   ELSE 'Active' END AS promotion_status
FROM customer_packages cp JOIN promotions pr ON pr.id = cp.promotion_id""")
def _promotion_status(t):
    """E7 for the promotion of every subscription that has one."""
    return _with_promotion(t).select(
        "id", E.promotion_status("active", "valid_until", AS_OF).alias("promotion_status"))


def _with_promotion(t):
    pr = t["promotions"].select(F.col("id").alias("__mid"), "active", "valid_until",
                                "discount_percent", "discount_amount")
    cp = t["customer_packages"].select("id", "promotion_id")
    return cp.join(small_side(pr, t["promotions"]), F.col("promotion_id") == F.col("__mid"))


NUM = r"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '(\.[0-9]*[1-9])0+$', '\1'), '\.0+$', '')"


@register("discount_label", """
SELECT cp.id, coalesce(nullif(concat_ws(' / ', """ + NUM.replace("{x}", "pr.discount_percent")
          + " || '%', '$' || " + NUM.replace("{x}", "pr.discount_amount")
          + """), ''), '—') AS discount_label
FROM customer_packages cp JOIN promotions pr ON pr.id = cp.promotion_id""")
def _discount_label(t):
    """E8 for the promotion of every subscription that has one."""
    return _with_promotion(t).select(
        "id", E.discount_label("discount_percent", "discount_amount").alias("discount_label"))


@register("features_parse", """
SELECT id, array_to_string(list_filter(list_transform(string_split(coalesce(features_text, ''), ','),
           lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|') AS features
FROM package_features_text""")
def _features_parse(t):
    """E9 over the feature text typed into the package form."""
    return t["package_features_text"].select(
        "id", E.features_parse("features_text").alias("features"))


@register("features_text", """
SELECT id, array_to_string(coalesce(features, CAST([] AS VARCHAR[])), ', ') AS features_text
FROM packages""")
def _features_text(t):
    """E10 over packages."""
    return t["packages"].select("id", E.features_text("features").alias("features_text"))


@register("iso_date", "SELECT id, strftime(expires_at, '%Y-%m-%d') AS expires_on FROM customer_packages")
def _iso_date(t):
    """E11 over subscriptions."""
    return t["customer_packages"].select("id", E.iso_date("expires_at").alias("expires_on"))


@register("price_text", """
SELECT id, CASE WHEN price_paid IS NULL THEN '—' ELSE '$' || CAST(price_paid AS VARCHAR) END
       AS price_text FROM customer_packages""")
def _price_text(t):
    """E12 over subscriptions."""
    return t["customer_packages"].select("id", E.price_text("price_paid").alias("price_text"))


@register("revenue_text", """
SELECT package_id, format('{:,.2f}', coalesce(sum(price_paid), 0)) AS revenue_text
FROM customer_packages GROUP BY package_id""")
def _revenue_text(t):
    """E13 over the revenue of each package."""
    rev = (t["customer_packages"].groupBy("package_id")
           .agg(F.coalesce(F.sum("price_paid"), F.lit(0).cast("decimal(20,2)")).alias("rev")))
    return rev.select("package_id", E.revenue_text("rev").alias("revenue_text"))


@register("html_escape", "SELECT page_id, " + esc_sql("html") + " AS html_escaped FROM pages")
def _html_escape(t):
    """E14 over the raw web pages (whole texts)."""
    return t["pages"].select("page_id", E.html_escape("html").alias("html_escaped"))


@register("default_terms", """
SELECT d.row_id, d.package_id,
       CAST(CAST({AS_OF} AS DATE) + CAST(coalesce(p.duration_days, 30) AS INTEGER) AS TIMESTAMP)
       AS default_expires_at,
       CAST(p.price AS DOUBLE) AS default_price
FROM dirty_subscriptions d LEFT JOIN packages p ON p.id = d.package_id""")
def _default_terms(t):
    """E15 over the requested packages (30 days when the package is unknown)."""
    return V.default_terms(t["dirty_subscriptions"], t["packages"], AS_OF)


@register("horizon_interval", """
SELECT id, expires_at + to_microseconds(CAST(2.5 * 86400000000 AS BIGINT)) AS end_fixed,
       expires_at + to_microseconds(CAST(package_id * 86400000000 / 8 AS BIGINT)) AS end_by_row
FROM customer_packages""")
def _horizon_interval(t):
    """Fixed and per-row fractional day horizons added to expiries."""
    cp = t["customer_packages"]
    return cp.select("id", (F.col("expires_at") + horizon_interval(2.5)).alias("end_fixed"),
                     (F.col("expires_at") + horizon_interval(F.col("package_id") / F.lit(8)))
                     .alias("end_by_row"))
