"""Registered read queries: scans, projections, filters, joins (S, P, F, J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators import changes as CH
from halyard.operators import ngrams as NG
from halyard.operators import records as R
from halyard.operators import views as V
from halyard.plans.catalog import AS_OF, register
from halyard.session import scratch_dir
from halyard.sources import schemas as S
from halyard.sources import tables as TB
from halyard.sources.fixtures import overlay

SUB_RECORD = """
SELECT cp.id, cp.customer_id, c.first_name || ' ' || c.last_name AS customer_name,
       c.email AS customer_email, cp.package_id, p.name AS package_name,
       cp.promotion_id, pr.name AS promotion_name, cp.joined_at, cp.expires_at,
       CAST(cp.price_paid AS DOUBLE) AS price_paid, cp.status, cp.created_at, cp.updated_at
FROM customer_packages cp
JOIN customers c ON c.id = cp.customer_id
JOIN packages p ON p.id = cp.package_id
LEFT JOIN promotions pr ON pr.id = cp.promotion_id
"""

PACKAGE_RECORD = """
SELECT id, name, description, CAST(price AS DOUBLE) AS price, duration_days,
       array_to_string(coalesce(features, CAST([] AS VARCHAR[])), '|') AS features,
       active, created_at, updated_at
FROM packages"""

PROMOTION_RECORD = """
SELECT id, name, description, CAST(discount_percent AS DOUBLE) AS discount_percent,
       CAST(discount_amount AS DOUBLE) AS discount_amount, valid_from, valid_until,
       active, created_at, updated_at
FROM promotions"""

COMPANY_RECORD = """
SELECT co.id, co.name, co.email, co.phone, co.address,
       CAST(coalesce(n.cnt, 0) AS BIGINT) AS customer_count, co.created_at, co.updated_at
FROM companies co
LEFT JOIN (SELECT company_id, count(*) AS cnt FROM customers
           WHERE company_id IS NOT NULL GROUP BY company_id) n ON n.company_id = co.id"""

CURRENT = """
cur AS (SELECT * EXCLUDE (rn) FROM (
          SELECT cp.*, row_number() OVER (PARTITION BY customer_id
                                          ORDER BY expires_at DESC, id DESC) AS rn
          FROM customer_packages cp WHERE status = 'active') WHERE rn = 1)"""

CUSTOMER_RECORD = "WITH " + CURRENT + """
SELECT c.id, c.first_name, c.last_name, c.email, c.phone, c.status, c.notes, c.company_id,
       co.name AS company_name, c.created_at, c.updated_at, cur.id AS cp_id, cur.package_id,
       p.name AS package_name, cur.joined_at, cur.expires_at, cur.status AS cp_status,
       CAST(cur.price_paid AS DOUBLE) AS price_paid, cur.promotion_id,
       pr.name AS promotion_name
FROM customers c
LEFT JOIN companies co ON co.id = c.company_id
LEFT JOIN cur ON cur.customer_id = c.id
LEFT JOIN packages p ON p.id = cur.package_id
LEFT JOIN promotions pr ON pr.id = cur.promotion_id"""

CANDIDATES = """
SELECT cp.id AS cp_id, c.first_name || ' ' || c.last_name AS customer_name, c.email,
       p.name AS package_name, cp.joined_at, cp.expires_at,
       CAST(trunc(epoch(cp.expires_at - {AS_OF}) / 86400) AS INTEGER) AS days_left,
       CAST(cp.price_paid AS VARCHAR) AS price_paid
FROM customer_packages cp
JOIN customers c ON c.id = cp.customer_id
JOIN packages p ON p.id = cp.package_id
WHERE cp.status = 'active'
  AND cp.expires_at BETWEEN {AS_OF} AND {AS_OF} + INTERVAL '%d' DAY"""

NUM_TEXT = r"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '(\.[0-9]*[1-9])0+$', '\1'), '\.0+$', '')"


def num_text(x: str) -> str:
    return NUM_TEXT.replace("{x}", x)


# -- S ---------------------------------------------------------------------------------

SEVEN = ["companies", "packages", "promotions", "package_promotions", "customers",
         "customer_packages", "notification_log"]


def _scan_sql(name: str) -> str:
    cells = " + ".join(f"count({f.name})" for f in S.TABLES[name])
    texts = " + ".join(f"coalesce(sum(length({f.name})), 0)" for f in S.TABLES[name] if f.dataType.simpleString() == "string")
    newest = "sent_at" if name == "notification_log" else "updated_at" if name != "package_promotions" else "CAST(NULL AS TIMESTAMP)"
    return (f"SELECT '{name}' AS table_name, count(*) AS row_count, CAST({cells} AS BIGINT) AS cells, "
            f"CAST({texts or 0} AS BIGINT) AS text_chars, CAST(sum(id) AS BIGINT) AS id_sum, max({newest}) AS newest FROM {name}")


@register("table_scan", "\nUNION ALL\n".join(map(_scan_sql, SEVEN)))
def _table_scan(t):
    """The seven tables, published as one commit and loaded under their
    declared schemas, every column read. A later version that no commit
    record names is not seen."""
    spark = t["customers"].sparkSession
    path = scratch_dir(spark, "published")
    TB.publish(spark, path, {n: t[n] for n in SEVEN})
    TB.write_table(t["customers"].limit(0), path, "customers", 99)     # a writer that got no further
    loaded = TB.load_tables(spark, path)
    parts = []
    for n in SEVEN:
        fields = S.TABLES[n]
        texts = [F.coalesce(F.sum(F.length(f.name)), F.lit(0)) for f in fields if f.dataType.simpleString() == "string"]
        newest = "sent_at" if n == "notification_log" else "updated_at"
        parts.append(loaded[n].agg(
            F.count(F.lit(1)).alias("row_count"), reduce(lambda a, b: a + b, [F.count(f.name) for f in fields]).alias("cells"),
            reduce(lambda a, b: a + b, texts, F.lit(0).cast("bigint")).alias("text_chars"), F.sum("id").alias("id_sum"),
            (F.max(newest) if newest in fields.fieldNames() else F.lit(None).cast("timestamp_ntz")).alias("newest"))
            .select(F.lit(n).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


@register("package_catalog", PACKAGE_RECORD)
def _package_catalog(t):
    """All packages, cheapest first."""
    return R.package_record(V.package_catalog(t))


@register("promotion_catalog", PROMOTION_RECORD)
def _promotion_catalog(t):
    """S3: all promotions, latest end first."""
    return R.promotion_record(V.promotion_catalog(t))


@register("key_lookup", """
SELECT d.row_id, d.package_id AS key, p.id IS NOT NULL AS found, p.name,
       CAST(p.price AS DOUBLE) AS price
FROM dirty_subscriptions d LEFT JOIN packages p ON p.id = d.package_id""")
def _key_lookup(t):
    """Every requested package id looked up (NULL keys are not found)."""
    keys = t["dirty_subscriptions"].select("row_id", F.col("package_id").alias("key"))
    out = V.lookup(t["packages"].select("id", "name", "price"), keys, "key")
    return out.select("row_id", "key", "found", "name", F.col("price").cast("double").alias("price"))


@register("notification_append", """
WITH cand AS (""" + CANDIDATES % 30 + """)
SELECT * FROM notification_log
UNION ALL
SELECT (SELECT max(id) FROM notification_log) + row_number() OVER (ORDER BY expires_at, cp_id) AS id,
       'package_expiry' AS type, 'admin@example.com' AS recipient_email,
       'Package Expiry Alert - 30 day horizon' AS subject, {AS_OF} AS sent_at,
       CAST(NULL AS BIGINT) AS customer_id, cp_id AS customer_package_id, TRUE AS success,
       CAST(NULL AS VARCHAR) AS error_message
FROM cand""")
def _notification_append(t):
    """The log after one append of a row per reminded subscription."""
    cand = V.reminder_rows(t, 30, AS_OF)
    return TB.notification_append(t["notification_log"], cand, "admin@example.com", 30, AS_OF)


@register("seed_if_absent", """
WITH firsts AS (SELECT name, min(row_id) AS row_id FROM company_requests GROUP BY name),
fresh AS (SELECT f.* FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.name = f.name))
SELECT (SELECT max(id) FROM companies) + row_number() OVER (ORDER BY row_id) AS id, name, row_id
FROM fresh""")
def _seed_if_absent(t):
    """Companies inserted only where the name is absent."""
    return TB.insert_if_absent(t["companies"], t["company_requests"], ["name"], "row_id") \
        .select("id", "name", "row_id")


# -- P ---------------------------------------------------------------------------------

@register("company_record", COMPANY_RECORD)
def _company_record(t):
    """Company rows with their customer count."""
    return R.company_record(V.companies_with_counts(t))


@register("package_record", PACKAGE_RECORD)
def _package_record(t):
    """Package rows (price as double, features never NULL)."""
    return R.package_record(t["packages"])


@register("promotion_record", PROMOTION_RECORD)
def _promotion_record(t):
    """Promotion rows (percent and amount as double)."""
    return R.promotion_record(t["promotions"])


@register("customer_record", CUSTOMER_RECORD)
def _customer_record(t):
    """The 20-field customer row with its current subscription."""
    return R.customer_record(V.customer_360(t))


@register("subscription_record", SUB_RECORD)
def _subscription_record(t):
    """P5: the 14-field subscription row."""
    return R.subscription_record(V.subscription_enriched(t))


# -- F ---------------------------------------------------------------------------------

@register("customers_by_status", CUSTOMER_RECORD + "\nWHERE c.status = 'active'")
def _customers_by_status(t):
    """customers with status active."""
    return R.customer_record(V.filter_customers(V.customer_360(t), status="active"))


@register("customers_by_company", CUSTOMER_RECORD + "\nWHERE c.company_id = 7")
def _customers_by_company(t):
    """customers of company 7."""
    return R.customer_record(V.filter_customers(V.customer_360(t), company_id=7))


SEARCH = "1_3"
SEARCH_SQL = ("(c.first_name ILIKE '%{s}%' OR c.last_name ILIKE '%{s}%' "
              "OR c.email ILIKE '%{s}%')")


@register("customer_search", CUSTOMER_RECORD + "\nWHERE " + SEARCH_SQL.format(s=SEARCH))
def _customer_search(t):
    """case-insensitive substring search; ``_`` is a wildcard."""
    return R.customer_record(V.filter_customers(V.customer_360(t), search=SEARCH))


INDEXED = "NITURE.1"


@register("indexed_search", CUSTOMER_RECORD + "\nWHERE " + SEARCH_SQL.format(s=INDEXED))
def _indexed_search(t):
    """F3 through an index of trigrams, written and read back: the same rows
    as the scan, from the postings of the term's rarest trigrams."""
    spark = t["customers"].sparkSession
    path = scratch_dir(spark, "name-grams")
    NG.write_postings(NG.postings(t["customers"]), path)
    hits = NG.indexed_search(t["customers"], lambda grams: NG.read_postings(spark, path, grams), INDEXED)
    return R.customer_record(V.customer_360(overlay(t, customers=hits)))


@register("customers_filtered", CUSTOMER_RECORD
          + "\nWHERE c.status = 'active' AND c.company_id = 3 AND " + SEARCH_SQL.format(s="MOBILE"))
def _customers_filtered(t):
    """status, company and search together, newest first."""
    return V.list_customers(t, status="active", company_id=3, search="MOBILE")


@register("subscription_history", SUB_RECORD
          + "\nWHERE cp.customer_id IN (SELECT id FROM customers WHERE status = 'churned')")
def _subscription_history(t):
    """the subscription histories of the churned customers."""
    churned = t["customers"].where(F.col("status") == "churned").select("id")
    return V.list_subscriptions(t, customer_ids=churned)


@register("subscriptions_by_status", SUB_RECORD + "\nWHERE cp.status = 'cancelled'")
def _subscriptions_by_status(t):
    """cancelled subscriptions."""
    return V.list_subscriptions(t, status="cancelled")


@register("expiring_within", SUB_RECORD + """
WHERE cp.status = 'active'
  AND cp.expires_at BETWEEN {AS_OF} AND {AS_OF} + INTERVAL '30' DAY""")
def _expiring_within(t):
    """active subscriptions expiring within 30 days (the flagship)."""
    return V.expiring_within(t, 30, AS_OF)


@register("active_package_options", f"""
SELECT id, name || ' ($' || {num_text('price')} || ' / ' || CAST(duration_days AS VARCHAR) || 'd)' AS label
FROM packages WHERE active""")
def _active_package_options(t):
    """F8: active packages labelled ``name ($price / Nd)``."""
    return V.package_options(t)


@register("active_promotion_options", f"""
SELECT id, name
       || coalesce(' (' || {num_text('discount_percent')} || '%)', '')
       || coalesce(' ($' || {num_text('discount_amount')} || ' off)', '') AS label
FROM promotions WHERE active""")
def _active_promotion_options(t):
    """active promotions labelled ``name (P%) ($A off)``."""
    return V.promotion_options(t)


# -- J ---------------------------------------------------------------------------------

@register("company_list", COMPANY_RECORD)
def _company_list(t):
    """Companies with customer counts, by name."""
    return V.company_list(t)


@register("subscription_enriched", """
SELECT cp.* REPLACE (CAST(cp.price_paid AS DOUBLE) AS price_paid), c.first_name, c.last_name, c.email, p.name AS package_name,
       pr.name AS promotion_name
FROM customer_packages cp
JOIN customers c ON c.id = cp.customer_id
JOIN packages p ON p.id = cp.package_id
LEFT JOIN promotions pr ON pr.id = cp.promotion_id""")
def _subscription_enriched(t):
    """Subscriptions with customer, package and promotion."""
    return V.subscription_enriched(t)


@register("current_subscription", "WITH " + CURRENT
          + "\nSELECT * REPLACE (CAST(price_paid AS DOUBLE) AS price_paid) FROM cur")
def _current_subscription(t):
    """Each customer's latest active subscription."""
    return V.current_subscription(t)


@register("customer_360", CUSTOMER_RECORD)
def _customer_360(t):
    """Customers with company, current subscription, package, promotion."""
    return V.customer_360(t)


@register("reminder_candidates", CANDIDATES % 7)
def _reminder_candidates(t):
    """The reminder candidates of the default 7-day horizon."""
    return V.reminder_candidates(t, 7, AS_OF)


@register("assign_if_none", """
WITH req AS (
  SELECT r.seq, c.id AS customer_id, p.id AS package_id, pr.id AS promotion_id,
         r.joined_at, r.expires_at, r.price_paid, r.status
  FROM assignment_requests r
  JOIN customers c ON c.email = r.customer_email
  JOIN (SELECT name, min(id) AS id FROM packages GROUP BY name) p ON p.name = r.package_name
  LEFT JOIN (SELECT name, min(id) AS id FROM promotions GROUP BY name) pr
    ON pr.name = r.promotion_name
  WHERE (r.promotion_name IS NULL OR pr.id IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM customer_packages cp
                    WHERE cp.customer_id = c.id AND cp.status = 'active')),
firsts AS (SELECT customer_id, min(seq) AS seq FROM req GROUP BY customer_id),
kept AS (SELECT req.* FROM req JOIN firsts USING (customer_id, seq))
SELECT seq, (SELECT max(id) FROM customer_packages)
            + row_number() OVER (ORDER BY seq) AS id,
       customer_id, package_id, promotion_id, joined_at, expires_at,
       CAST(price_paid AS DOUBLE) AS price_paid, status,
       {AS_OF} AS created_at, {AS_OF} AS updated_at
FROM kept""")
def _assign_if_none(t):
    """A subscription for customers without an active one."""
    return CH.assign_if_none(t, t["assignment_requests"], AS_OF)


@register("resolve_collated", """
SELECT r.row_id, CASE WHEN r.row_id % 3 = 0 THEN lower(r.name) ELSE r.name END AS name, m.id AS resolved_id
FROM company_requests r
LEFT JOIN (SELECT lower(name) AS name, min(id) AS id FROM companies GROUP BY 1) m ON m.name = lower(r.name)""")
def _resolve_collated(t):
    """J7 in a collation that does not tell letters from their capitals."""
    asked = t["company_requests"].select("row_id", F.when(F.col("row_id") % 3 == 0, F.lower("name")).otherwise(F.col("name")).alias("name"))
    return V.resolve_by_name(asked, t["companies"], "name", collation="UNICODE_CI").select("row_id", "name", "resolved_id")


@register("resolve_by_name", """
SELECT r.row_id, r.name, m.id AS resolved_id
FROM company_requests r
LEFT JOIN (SELECT name, min(id) AS id FROM companies GROUP BY name) m ON m.name = r.name""")
def _resolve_by_name(t):
    """Company id by name (NULL when absent, lowest id when several)."""
    return V.resolve_by_name(t["company_requests"], t["companies"], "name") \
        .select("row_id", "name", "resolved_id")
