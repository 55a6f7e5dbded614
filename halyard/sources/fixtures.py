"""Entity tables derived from the driver's TPC-H-style parquet tables.

``fixture_tables(spark, sf_dir)`` builds the seven tables (conformed to the
declared schemas), the change feed and the dirty request batches as lazy
DataFrames over the parquet scans, so Catalyst prunes columns and pushes
filters into each scan. ``FIXTURE_SQL`` holds the same views as SQL text
for the independent DuckDB oracle.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.time import at
from halyard.sources import schemas as S

AS_OF_TEXT = "2001-08-01 12:00:00"
BASE_TEXT = "1995-01-01 00:00:00"
PROMO_TEXT = "2001-06-01 00:00:00"

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "events"]


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def _null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def companies_view(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    return nation.select(
        k.alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lower("n_name"), F.lit("@example.com")).alias("email"),
        F.when(k % 3 == 0, _null("string"))
         .otherwise(F.concat(F.lit("+1-555-"), F.lpad(_s(k), 4, "0"))).alias("phone"),
        F.concat(F.lit("Region "), _s(F.col("n_regionkey"))).alias("address"),
        at(BASE_TEXT).alias("created_at"), at(BASE_TEXT).alias("updated_at"))


def packages_view(part: DataFrame, with_text: bool = False) -> DataFrame:
    size = F.col("p_size")
    cols = [
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.when(size % 7 == 0, _null("string")).otherwise(F.col("p_type")).alias("description"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        (F.lit(30) * (F.lit(1) + size % 12)).alias("duration_days"),
        F.when(size % 11 == 0, _null("array<string>"))
         .otherwise(F.split(F.concat("p_brand", F.lit(","), "p_type"), ",")).alias("features"),
        (size <= 40).alias("active"),
        at(BASE_TEXT).alias("created_at"), at(BASE_TEXT).alias("updated_at"),
    ]
    if with_text:
        cols.append(F.concat("p_brand", F.lit(" , "), "p_type", F.lit(",, size "), _s(size))
                    .alias("features_text"))
    return part.select(cols)


def promotions_view(region: DataFrame) -> DataFrame:
    r = F.col("r_regionkey")
    return region.select(
        r.alias("id"), F.col("r_name").alias("name"), _null("string").alias("description"),
        F.when(r.isin(3, 4), _null("decimal(5,2)"))
         .otherwise((F.lit(5) * (F.lit(1) + r)).cast("decimal(5,2)")).alias("discount_percent"),
        F.when(r.isin(2, 3), F.lit(10).cast("decimal(10,2)")).alias("discount_amount"),
        at(PROMO_TEXT).alias("valid_from"),
        (at(AS_OF_TEXT) + _days((r - 2) * 10)).alias("valid_until"),
        (r != 3).alias("active"),
        at(PROMO_TEXT).alias("created_at"), at(PROMO_TEXT).alias("updated_at"))


def package_promotions_view(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(k.alias("id"), k.alias("package_id"),
                       (k % 5).cast("int").alias("promotion_id"))


def customers_view(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    bal = F.col("c_acctbal")
    created = at(AS_OF_TEXT) - _days(k % 400)
    return customer.select(
        k.alias("id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.concat(F.lower("c_mktsegment"), F.lit("."), _s(k), F.lit("@example.com")).alias("email"),
        F.when(k % 4 == 0, _null("string"))
         .otherwise(F.concat(F.lit("+1-555-"), F.lpad(_s(k % 10000), 4, "0"))).alias("phone"),
        F.when(F.col("c_nationkey") % 5 == 4, _null("int"))
         .otherwise(F.col("c_nationkey")).alias("company_id"),
        F.when(bal < 0, "churned").when(bal < 1000, "inactive").otherwise("active").alias("status"),
        F.when(k % 5 == 0, F.lit("VIP client")).alias("notes"),
        created.alias("created_at"), created.alias("updated_at"))


def customer_packages_view(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.col("o_orderdate")
    return orders.select(
        k.alias("id"), F.col("o_custkey").alias("customer_id"), (k % 200).alias("package_id"),
        F.when(k % 3 == 0, (k % 5).cast("int")).alias("promotion_id"),
        day.alias("joined_at"),
        (day + _days(F.lit(30) * (F.lit(1) + k % 12)) + _hours(k % 24)).alias("expires_at"),
        F.when(k % 13 == 0, _null("decimal(10,2)"))
         .when(k % 17 == 0, F.lit(0).cast("decimal(10,2)"))
         .otherwise(F.col("o_totalprice").cast("decimal(10,2)")).alias("price_paid"),
        F.when(F.col("o_orderstatus") == "O", "active")
         .when(F.col("o_orderstatus") == "F", "expired").otherwise("cancelled").alias("status"),
        day.alias("created_at"), day.alias("updated_at"))


def notification_log_view(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("id"), F.lit("package_expiry").alias("type"),
        F.lit("admin@example.com").alias("recipient_email"),
        F.lit("Package Expiry Alert - 7 day horizon").alias("subject"),
        F.col("o_orderdate").alias("sent_at"), _null("bigint").alias("customer_id"),
        k.alias("customer_package_id"), F.lit(True).alias("success"),
        _null("string").alias("error_message"))


def customer_changes_view(events: DataFrame) -> DataFrame:
    """Every event is a change: views and signups set the status, clicks and
    purchases the notes (some to NULL), errors a status that no rule allows,
    or are deletes."""
    et, eid = F.col("event_type"), F.col("event_id")
    status, delete = et.isin("view", "signup", "error"), (et == "error") & (eid % 97 == 0)
    bucket = F.floor("value").cast("int") % 3
    return events.select(
        eid.alias("seq"), F.col("ts"), F.col("user_id").alias("id"),
        F.when(delete, "delete").otherwise("patch").alias("op"),
        (status & ~delete).alias("set_status"),
        F.when(et == "error", F.when(~delete, "error")).when(et == "signup", "active").when(
            et == "view", F.when(bucket == 0, "active").when(bucket == 1, "inactive").otherwise("churned")).alias("status"),
        et.isin("click", "purchase").alias("set_notes"),
        F.when((et == "click") & (eid % 3 != 0), F.concat(F.lit("clicked "), _s(eid)))
         .when(et == "purchase", F.concat(F.lit("bought "), _s(eid))).alias("notes"))


def customer_edits_view(events: DataFrame, customer: DataFrame) -> DataFrame:
    """Every event is an edit of a customer's form: signups and purchases
    change the e-mail address, to that of the customer itself or of one of the
    next two, to one that many ask for, or to one of a few; clicks set the
    notes, views the status; errors are addresses that are none, or deletes."""
    et, eid, k = F.col("event_type"), F.col("event_id"), F.col("c_custkey")
    other = F.concat(F.lower("c_mktsegment"), F.lit("."), _s(k), F.lit("@example.com"))
    j = events.join(customer.select("c_custkey", "c_mktsegment"), F.col("user_id") + eid % 3 == k, "left")
    delete = (et == "error") & (eid % 97 == 0)
    mail = et.isin("signup", "purchase") | (et == "error") & ~delete
    return j.select(
        eid.alias("seq"), F.col("user_id").alias("id"), F.when(delete, "delete").otherwise("patch").alias("op"),
        mail.alias("set_email"),
        F.when(et == "error", F.when(~delete, "no address")).when(et == "signup", other).when(et == "purchase", F.when(
            eid % 4 == 0, "shared@example.com").otherwise(F.concat(F.lit("m"), _s(eid % 50), F.lit("@example.com")))).alias("email"),
        (et == "view").alias("set_status"), F.when(et == "view", "inactive").alias("status"),
        et.isin("click", "signup").alias("set_notes"),
        F.when(et == "click", F.concat(F.lit("clicked "), _s(eid))).alias("notes"))


def dirty_customers_view(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("row_id"),
        F.when(k % 10 == 0, F.lit("")).when(k % 10 == 1, F.repeat(F.lit("x"), 101))
         .when(k % 10 == 2, _null("string")).otherwise(F.lit("Ann")).alias("first_name"),
        F.lit("Lee").alias("last_name"),
        F.when(k % 7 == 0, F.lit("not-an-email"))
         .otherwise(F.concat(F.lit("u"), _s(k % 1000), F.lit("@example.com"))).alias("email"),
        F.when(k % 6 == 0, F.repeat(F.lit("5"), 51)).alias("phone"),
        F.when(k % 9 == 0, F.lit("paused")).otherwise(F.lit("active")).alias("status"))


def dirty_subscriptions_view(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    m5 = k % 5
    return orders.select(
        k.alias("row_id"), F.col("o_custkey").alias("customer_id"),
        F.when(k % 11 == 0, _null("bigint")).otherwise(k % 400).alias("package_id"),
        F.when(m5 == 0, "2024-01-01").when(m5 == 1, "2024-01-01T00:00:00+02:00")
         .when(m5 == 2, "junk").otherwise("2024-01-01T00:00:00.000Z").alias("expires_at"),
        F.when(k % 8 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")).alias("price_paid"),
        F.when(k % 9 == 0, "paused").otherwise("active").alias("status"))


def dirty_package_promotions_view(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(k.alias("id"), ((k * 2) % 300).alias("package_id"),
                       (k % 7).cast("int").alias("promotion_id"))


def dirty_companies_view(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    m6 = k % 6
    return customer.select(
        k.alias("row_id"),
        F.when(k % 8 == 0, F.lit("")).when(k % 8 == 1, F.repeat(F.lit("n"), 201))
         .otherwise(F.col("c_name")).alias("name"),
        F.when(m6 == 0, F.lit("acme.example.com")).when(m6 == 1, _null("string"))
         .otherwise(F.concat(F.lit("info"), _s(k), F.lit("@example.com"))).alias("email"),
        F.when(k % 10 == 3, F.repeat(F.lit("9"), 51)).otherwise(F.lit("+1-555-0100")).alias("phone"),
        F.when(k % 12 == 5, F.repeat(F.lit("a"), 1001)).otherwise(F.col("c_mktsegment")).alias("address"))


def dirty_packages_view(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    m7 = k % 7
    return part.select(
        k.alias("row_id"),
        F.when(k % 9 == 0, F.lit("")).when(k % 9 == 1, F.repeat(F.lit("p"), 101))
         .otherwise(F.col("p_name")).alias("name"),
        F.when(k % 10 == 2, F.repeat(F.lit("d"), 2001)).otherwise(F.col("p_type")).alias("description"),
        F.when(k % 13 == 6, _null("double")).when(k % 8 == 3, -F.col("p_retailprice"))
         .otherwise(F.col("p_retailprice")).alias("price"),
        F.when(m7 == 4, F.lit(0.0)).when(m7 == 5, F.lit(30.5)).when(m7 == 6, _null("double"))
         .otherwise((F.lit(30) * (F.lit(1) + F.col("p_size") % 12)).cast("double")).alias("duration_days"),
        F.split("p_brand", "#").alias("features"),
        (F.col("p_size") <= 40).alias("active"))


def dirty_promotions_view(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    m6 = k % 6
    m5 = k % 5
    m4 = k % 4
    return orders.select(
        k.alias("row_id"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("name"),
        _null("string").alias("description"),
        F.when(m6 == 0, _null("double")).when(m6 == 1, F.lit(120.0)).when(m6 == 2, F.lit(-5.0))
         .otherwise((k % 50).cast("double")).alias("discount_percent"),
        F.when(m4 == 0, F.lit(-1.0)).when(m4 == 1, _null("double")).otherwise(F.lit(10.0))
         .alias("discount_amount"),
        F.when(m5 == 0, "2024-02-30T00:00:00Z").when(m5 == 1, "2024-01-01T00:00:00+02:00")
         .otherwise("2024-01-01T00:00:00Z").alias("valid_from"),
        F.when(k % 7 == 0, "2024-12-31").otherwise("2024-12-31T23:59:59.5Z").alias("valid_until"),
        (k % 2 == 0).alias("active"))


# -- request bodies as JSON text (the same expression in Spark and DuckDB SQL) --------

_OPEN = """'{"firstName": "Ann", "lastName": "Lee", "email": "j' || CAST(c_custkey AS STRING) || '@example.com"'"""
JSON_CUSTOMER = f"""CASE c_custkey % 14
  WHEN 0 THEN {_OPEN} || ', "companyId": 3, "notes": "ok"}}'
  WHEN 1 THEN '{{"firstName": "", "email": "j1@example"}}'
  WHEN 2 THEN {_OPEN} || ', "phone": null, "companyId": null}}'
  WHEN 3 THEN {_OPEN} || ', "status": null}}'
  WHEN 4 THEN '{{"firstName": 7, "lastName": ["Lee"], "email": null}}'
  WHEN 5 THEN {_OPEN}
  WHEN 6 THEN '[1, 2]'
  WHEN 7 THEN {_OPEN} || ', "companyId": 2.5, "phone": ' || CAST(c_custkey AS STRING) || '}}'
  WHEN 8 THEN {_OPEN} || ', "packageAssignment": {{"packageId": 5, "expiresAt": "2024-02-30T00:00:00Z", "pricePaid": -1}}}}'
  WHEN 9 THEN {_OPEN} || ', "packageAssignment": "none"}}'
  WHEN 10 THEN {_OPEN} || ', "notes": "' || repeat('n', 2001) || '"}}'
  WHEN 11 THEN ''
  WHEN 12 THEN {_OPEN} || ', "packageAssignment": {{"packageId": 5, "joinedAt": null, "expiresAt": "2024-03-01T00:00:00Z"}}, "extra": {{"a": [1]}}}}'
  ELSE {_OPEN} || ', "status": "paused", "companyId": 99999999999, "packageAssignment": null}}' END"""
JSON_PATCH = """CASE event_type
  WHEN 'view' THEN '{"status": "inactive"}'
  WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN '{"notes": null}' ELSE '{"notes": "clicked ' || CAST(event_id AS STRING) || '"}' END
  WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN '{}' ELSE '{"companyId": ' || CAST(event_id % 40 AS STRING) || '}' END
  WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN '{"status": null, "notes": "lost"}' ELSE '{"phone": 5}' END
  ELSE CASE WHEN event_id % 2 = 0 THEN 'oops' ELSE '{"notes": "a", "notes' END END"""


# -- request batches derived from the driver tables (write-path inputs) --------------

def company_requests_view(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Company names to seed or resolve: even suppliers ask for their
    nation's name (already a company), odd ones for their own name."""
    j = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    return j.select(F.col("s_suppkey").alias("row_id"),
                    F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name"))
                     .otherwise(F.col("s_name")).alias("name"))


def assignment_requests_view(customer: DataFrame, part: DataFrame) -> DataFrame:
    """One package request per customer, with the package's default terms."""
    k = F.col("c_custkey")
    j = customer.join(part, part["p_partkey"] == k % 50)
    return j.select(
        k.alias("seq"),
        F.concat(F.lower("c_mktsegment"), F.lit("."), _s(k), F.lit("@example.com"))
         .alias("customer_email"),
        F.col("p_name").alias("package_name"),
        F.when(k % 4 == 0, F.lit("ASIA")).when(k % 4 == 1, F.lit("ATLANTIS"))
         .alias("promotion_name"),
        at(AS_OF_TEXT).alias("joined_at"),
        (at(AS_OF_TEXT) + _days(F.lit(30) * (F.lit(1) + F.col("p_size") % 12))).alias("expires_at"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price_paid"),
        F.lit("active").alias("status"))


def customer_requests_view(supplier: DataFrame) -> DataFrame:
    """New customers with an optional nested subscription."""
    k = F.col("s_suppkey")
    sub = F.struct(((k * 37) % 2500).alias("package_id"),
                   F.when(k % 5 == 0, (k % 7).cast("bigint")).alias("promotion_id"),
                   F.lit(None).cast("string").alias("joined_at"),
                   F.when(k % 11 == 0, F.lit("junk"))
                    .otherwise(F.lit("2001-09-01T00:00:00Z")).alias("expires_at"),
                   F.col("s_acctbal").alias("price_paid"))
    return supplier.select(
        k.alias("row_id"), F.lit("Supplier").alias("first_name"),
        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.when(k % 7 == 0, F.lit("shared@example.com"))
         .otherwise(F.concat(F.lit("supplier."), _s(k), F.lit("@example.com"))).alias("email"),
        _null("string").alias("phone"),
        F.when(k % 13 == 0, F.lit(99).cast("bigint"))
         .otherwise(F.col("s_nationkey").cast("bigint")).alias("company_id"),
        F.when(F.col("s_acctbal") < 0, F.lit("inactive")).otherwise(F.lit("active")).alias("status"),
        _null("string").alias("notes"),
        F.when(k % 3 == 0, F.lit(None).cast(sub_type())).otherwise(sub).alias("subscription"))


def sub_type() -> str:
    return ("struct<package_id:bigint,promotion_id:bigint,joined_at:string,"
            "expires_at:string,price_paid:double>")


DIRTY_REQUEST_SCHEMAS = {
    "dirty_customers": [("row_id", "bigint"), ("first_name", "string"), ("last_name", "string"),
                        ("email", "string"), ("phone", "string"), ("status", "string")],
    "dirty_subscriptions": [("row_id", "bigint"), ("customer_id", "bigint"),
                            ("package_id", "bigint"), ("expires_at", "string"),
                            ("price_paid", "double"), ("status", "string")],
    "dirty_package_promotions": [("id", "bigint"), ("package_id", "bigint"),
                                 ("promotion_id", "bigint")],
    "dirty_companies": [("row_id", "bigint"), ("name", "string"), ("email", "string"),
                        ("phone", "string"), ("address", "string")],
    "dirty_packages": [("row_id", "bigint"), ("name", "string"), ("description", "string"),
                       ("price", "double"), ("duration_days", "double"),
                       ("features", "array<string>"), ("active", "boolean")],
    "dirty_promotions": [("row_id", "bigint"), ("name", "string"), ("description", "string"),
                         ("discount_percent", "double"), ("discount_amount", "double"),
                         ("valid_from", "string"), ("valid_until", "string"),
                         ("active", "boolean")],
}


def _cast_all(df: DataFrame, fields) -> DataFrame:
    return df.select([F.col(n).cast(t).alias(n) for n, t in fields])


class Tables(Mapping):
    """Table name -> DataFrame, each view built on first access and kept.

    Building a view only constructs (and analyses) its plan; nothing runs.
    Keeping them lets many queries of one session share the plans, and a
    query pays only for the views it reads.
    """

    def __init__(self, builders: dict):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._builders:
                raise KeyError(name)
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name) -> bool:
        return name in self._builders

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def overlay(t, **tables) -> ChainMap:
    """``t`` with some tables replaced, without building the others."""
    return ChainMap(dict(tables), t)


_CACHE: dict[str, tuple[SparkSession, Tables]] = {}


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All fixture views over ``sf_dir``, built lazily, one set per session
    (a new session gets new plans)."""
    key = sf_dir.rstrip("/")
    hit = _CACHE.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, _fixture_tables(spark, sf_dir))
        _CACHE[key] = hit
    return hit[1]


def _fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    raw_cache: dict[str, DataFrame] = {}

    def raw(name):
        if name not in raw_cache:
            raw_cache[name] = read_raw(spark, sf_dir, name)
        return raw_cache[name]

    b = {
        "companies": lambda: S.conform(companies_view(raw("nation")), S.COMPANIES),
        "packages": lambda: S.conform(packages_view(raw("part")), S.PACKAGES),
        "promotions": lambda: S.conform(promotions_view(raw("region")), S.PROMOTIONS),
        "package_promotions": lambda: S.conform(package_promotions_view(raw("part")),
                                                S.PACKAGE_PROMOTIONS),
        "customers": lambda: S.conform(customers_view(raw("customer")), S.CUSTOMERS),
        "customer_packages": lambda: S.conform(customer_packages_view(raw("orders")),
                                               S.CUSTOMER_PACKAGES),
        "notification_log": lambda: S.conform(notification_log_view(raw("orders")),
                                              S.NOTIFICATION_LOG),
        "customer_changes": lambda: S.conform(customer_changes_view(raw("events")),
                                              S.CUSTOMER_CHANGES),
        "customer_edits": lambda: customer_edits_view(raw("events"), raw("customer")),
        "json_customers": lambda: raw("customer").select(F.col("c_custkey").alias("row_id"), F.expr(JSON_CUSTOMER).alias("body")),
        "json_patches": lambda: raw("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"),
                                                     F.expr(JSON_PATCH).alias("body")),
        "package_features_text": lambda: packages_view(raw("part"), with_text=True)
                                         .select("id", "features_text"),
        "company_requests": lambda: company_requests_view(raw("supplier"), raw("nation")),
        "assignment_requests": lambda: assignment_requests_view(raw("customer"), raw("part")),
        "customer_requests": lambda: customer_requests_view(raw("supplier")),
        "pages": lambda: raw("pages"),
        # The change feed as a stream: the events files read by a file
        # stream source (a glob, since a stream source lists a folder).
        "customer_changes_stream": lambda: S.conform(customer_changes_view(
            spark.readStream.schema(raw("events").schema)
            .parquet(f"{sf_dir.rstrip('/')}/events*.parquet")), S.CUSTOMER_CHANGES),
    }
    b["customer_edits_stream"] = lambda: customer_edits_view(
        spark.readStream.schema(raw("events").schema).parquet(f"{sf_dir.rstrip('/')}/events*.parquet"), raw("customer"))
    dirty = {
        "dirty_customers": (dirty_customers_view, "customer"),
        "dirty_subscriptions": (dirty_subscriptions_view, "orders"),
        "dirty_package_promotions": (dirty_package_promotions_view, "part"),
        "dirty_companies": (dirty_companies_view, "customer"),
        "dirty_packages": (dirty_packages_view, "part"),
        "dirty_promotions": (dirty_promotions_view, "orders"),
    }
    for name, (build, src) in dirty.items():
        b[name] = (lambda build=build, src=src, name=name:
                   _cast_all(build(raw(src)), DIRTY_REQUEST_SCHEMAS[name]))
    return Tables(b)


# ---------------------------------------------------------------------------
# The same views as SQL text, for the DuckDB oracle (raw tables are views of
# the same names there). Each is wrapped by ``oracle`` in a cast to the
# declared column types.
# ---------------------------------------------------------------------------

FIXTURE_SQL = {
    "companies": """
SELECT n_nationkey AS id, n_name AS name,
       concat(lower(n_name), '@example.com') AS email,
       CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('+1-555-', lpad(CAST(n_nationkey AS VARCHAR), 4, '0')) END AS phone,
       concat('Region ', CAST(n_regionkey AS VARCHAR)) AS address,
       TIMESTAMP '1995-01-01 00:00:00' AS created_at, TIMESTAMP '1995-01-01 00:00:00' AS updated_at
FROM nation""",
    "packages": """
SELECT p_partkey AS id, p_name AS name,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS description,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price,
       30 * (1 + p_size % 12) AS duration_days,
       CASE WHEN p_size % 11 = 0 THEN NULL ELSE string_split(concat(p_brand, ',', p_type), ',') END AS features,
       p_size <= 40 AS active,
       TIMESTAMP '1995-01-01 00:00:00' AS created_at, TIMESTAMP '1995-01-01 00:00:00' AS updated_at
FROM part""",
    "package_features_text": """
SELECT p_partkey AS id, concat(p_brand, ' , ', p_type, ',, size ', CAST(p_size AS VARCHAR)) AS features_text
FROM part""",
    "promotions": """
SELECT r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS description,
       CASE WHEN r_regionkey IN (3, 4) THEN NULL ELSE CAST(5 * (1 + r_regionkey) AS DECIMAL(5,2)) END AS discount_percent,
       CASE WHEN r_regionkey IN (2, 3) THEN CAST(10 AS DECIMAL(10,2)) ELSE NULL END AS discount_amount,
       TIMESTAMP '2001-06-01 00:00:00' AS valid_from,
       TIMESTAMP '2001-08-01 12:00:00' + (r_regionkey - 2) * INTERVAL '10' DAY AS valid_until,
       r_regionkey <> 3 AS active,
       TIMESTAMP '2001-06-01 00:00:00' AS created_at, TIMESTAMP '2001-06-01 00:00:00' AS updated_at
FROM region""",
    "package_promotions": """
SELECT p_partkey AS id, p_partkey AS package_id, CAST(p_partkey % 5 AS INT) AS promotion_id FROM part""",
    "customers": """
SELECT c_custkey AS id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
       concat(lower(c_mktsegment), '.', CAST(c_custkey AS VARCHAR), '@example.com') AS email,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('+1-555-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) END AS phone,
       CASE WHEN c_nationkey % 5 = 4 THEN NULL ELSE c_nationkey END AS company_id,
       CASE WHEN c_acctbal < 0 THEN 'churned' WHEN c_acctbal < 1000 THEN 'inactive' ELSE 'active' END AS status,
       CASE WHEN c_custkey % 5 = 0 THEN 'VIP client' ELSE NULL END AS notes,
       TIMESTAMP '2001-08-01 12:00:00' - (c_custkey % 400) * INTERVAL '1' DAY AS created_at,
       TIMESTAMP '2001-08-01 12:00:00' - (c_custkey % 400) * INTERVAL '1' DAY AS updated_at
FROM customer""",
    "customer_packages": """
SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderkey % 200 AS package_id,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 5 AS INT) END AS promotion_id,
       o_orderdate AS joined_at,
       o_orderdate + (30 * (1 + o_orderkey % 12)) * INTERVAL '1' DAY + (o_orderkey % 24) * INTERVAL '1' HOUR AS expires_at,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST(o_totalprice AS DECIMAL(10,2)) END AS price_paid,
       CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'expired' ELSE 'cancelled' END AS status,
       o_orderdate AS created_at, o_orderdate AS updated_at
FROM orders""",
    "notification_log": """
SELECT o_orderkey AS id, 'package_expiry' AS type, 'admin@example.com' AS recipient_email,
       'Package Expiry Alert - 7 day horizon' AS subject, o_orderdate AS sent_at,
       CAST(NULL AS BIGINT) AS customer_id, o_orderkey AS customer_package_id,
       TRUE AS success, CAST(NULL AS VARCHAR) AS error_message
FROM orders""",
    "customer_changes": """
SELECT event_id AS seq, ts, user_id AS id,
       CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN 'delete' ELSE 'patch' END AS op,
       event_type IN ('view', 'signup') OR event_type = 'error' AND event_id % 97 <> 0 AS set_status,
       CASE event_type WHEN 'error' THEN CASE WHEN event_id % 97 <> 0 THEN 'error' END WHEN 'signup' THEN 'active'
            WHEN 'view' THEN CASE CAST(floor(value) AS INT) % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'churned' END END AS status,
       event_type IN ('click', 'purchase') AS set_notes,
       CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN concat('clicked ', CAST(event_id AS VARCHAR))
            WHEN event_type = 'purchase' THEN concat('bought ', CAST(event_id AS VARCHAR)) END AS notes
FROM events""",
    "customer_edits": """
SELECT event_id AS seq, user_id AS id, CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN 'delete' ELSE 'patch' END AS op,
       event_type IN ('signup', 'purchase') OR event_type = 'error' AND event_id % 97 <> 0 AS set_email,
       CASE event_type WHEN 'error' THEN CASE WHEN event_id % 97 <> 0 THEN 'no address' END
            WHEN 'signup' THEN lower(c_mktsegment) || '.' || CAST(c_custkey AS VARCHAR) || '@example.com'
            WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'shared@example.com' ELSE 'm' || CAST(event_id % 50 AS VARCHAR) || '@example.com' END
       END AS email,
       event_type = 'view' AS set_status, CASE WHEN event_type = 'view' THEN 'inactive' END AS status,
       event_type IN ('click', 'signup') AS set_notes,
       CASE WHEN event_type = 'click' THEN concat('clicked ', CAST(event_id AS VARCHAR)) END AS notes
FROM events LEFT JOIN customer ON c_custkey = user_id + event_id % 3""",
    "json_customers": f"SELECT c_custkey AS row_id, {JSON_CUSTOMER} AS body FROM customer",
    "json_patches": f"SELECT event_id AS seq, user_id AS id, {JSON_PATCH} AS body FROM events",
    "dirty_customers": """
SELECT c_custkey AS row_id,
       CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 101) WHEN 2 THEN NULL ELSE 'Ann' END AS first_name,
       'Lee' AS last_name,
       CASE WHEN c_custkey % 7 = 0 THEN 'not-an-email' ELSE concat('u', CAST(c_custkey % 1000 AS VARCHAR), '@example.com') END AS email,
       CASE WHEN c_custkey % 6 = 0 THEN repeat('5', 51) END AS phone,
       CASE WHEN c_custkey % 9 = 0 THEN 'paused' ELSE 'active' END AS status
FROM customer""",
    "dirty_subscriptions": """
SELECT o_orderkey AS row_id, o_custkey AS customer_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 400 END AS package_id,
       CASE o_orderkey % 5 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-01-01T00:00:00+02:00' WHEN 2 THEN 'junk' ELSE '2024-01-01T00:00:00.000Z' END AS expires_at,
       CASE WHEN o_orderkey % 8 = 0 THEN CAST(-1 AS DOUBLE) ELSE o_totalprice END AS price_paid,
       CASE WHEN o_orderkey % 9 = 0 THEN 'paused' ELSE 'active' END AS status
FROM orders""",
    "dirty_package_promotions": """
SELECT p_partkey AS id, (p_partkey * 2) % 300 AS package_id, CAST(p_partkey % 7 AS INT) AS promotion_id FROM part""",
    "dirty_companies": """
SELECT c_custkey AS row_id,
       CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN repeat('n', 201) ELSE c_name END AS name,
       CASE c_custkey % 6 WHEN 0 THEN 'acme.example.com' WHEN 1 THEN NULL ELSE concat('info', CAST(c_custkey AS VARCHAR), '@example.com') END AS email,
       CASE WHEN c_custkey % 10 = 3 THEN repeat('9', 51) ELSE '+1-555-0100' END AS phone,
       CASE WHEN c_custkey % 12 = 5 THEN repeat('a', 1001) ELSE c_mktsegment END AS address
FROM customer""",
    "dirty_packages": """
SELECT p_partkey AS row_id,
       CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN repeat('p', 101) ELSE p_name END AS name,
       CASE WHEN p_partkey % 10 = 2 THEN repeat('d', 2001) ELSE p_type END AS description,
       CASE WHEN p_partkey % 13 = 6 THEN NULL WHEN p_partkey % 8 = 3 THEN -p_retailprice ELSE p_retailprice END AS price,
       CASE p_partkey % 7 WHEN 4 THEN 0.0 WHEN 5 THEN 30.5 WHEN 6 THEN NULL ELSE CAST(30 * (1 + p_size % 12) AS DOUBLE) END AS duration_days,
       string_split(p_brand, '#') AS features,
       p_size <= 40 AS active
FROM part""",
    "dirty_promotions": """
SELECT o_orderkey AS row_id,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS name,
       CAST(NULL AS VARCHAR) AS description,
       CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 120.0 WHEN 2 THEN -5.0 ELSE CAST(o_orderkey % 50 AS DOUBLE) END AS discount_percent,
       CASE o_orderkey % 4 WHEN 0 THEN -1.0 WHEN 1 THEN NULL ELSE 10.0 END AS discount_amount,
       CASE o_orderkey % 5 WHEN 0 THEN '2024-02-30T00:00:00Z' WHEN 1 THEN '2024-01-01T00:00:00+02:00' ELSE '2024-01-01T00:00:00Z' END AS valid_from,
       CASE WHEN o_orderkey % 7 = 0 THEN '2024-12-31' ELSE '2024-12-31T23:59:59.5Z' END AS valid_until,
       o_orderkey % 2 = 0 AS active
FROM orders""",
    "company_requests": """
SELECT s.s_suppkey AS row_id, CASE WHEN s.s_suppkey % 2 = 0 THEN n.n_name ELSE s.s_name END AS name
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey""",
    "assignment_requests": """
SELECT c_custkey AS seq,
       concat(lower(c_mktsegment), '.', CAST(c_custkey AS VARCHAR), '@example.com') AS customer_email,
       p_name AS package_name,
       CASE c_custkey % 4 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'ATLANTIS' END AS promotion_name,
       TIMESTAMP '2001-08-01 12:00:00' AS joined_at,
       TIMESTAMP '2001-08-01 12:00:00' + (30 * (1 + p_size % 12)) * INTERVAL '1' DAY AS expires_at,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price_paid, 'active' AS status
FROM customer JOIN part ON p_partkey = c_custkey % 50""",
    "customer_requests": """
SELECT s_suppkey AS row_id, 'Supplier' AS first_name, split_part(s_name, '#', 2) AS last_name,
       CASE WHEN s_suppkey % 7 = 0 THEN 'shared@example.com' ELSE concat('supplier.', CAST(s_suppkey AS VARCHAR), '@example.com') END AS email,
       CAST(NULL AS VARCHAR) AS phone,
       CASE WHEN s_suppkey % 13 = 0 THEN CAST(99 AS BIGINT) ELSE CAST(s_nationkey AS BIGINT) END AS company_id,
       CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status,
       CAST(NULL AS VARCHAR) AS notes,
       s_suppkey % 3 <> 0 AS has_subscription,
       (s_suppkey * 37) % 2500 AS sub_package_id,
       CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 7 AS BIGINT) END AS sub_promotion_id,
       CASE WHEN s_suppkey % 11 = 0 THEN 'junk' ELSE '2001-09-01T00:00:00Z' END AS sub_expires_at,
       s_acctbal AS sub_price_paid
FROM supplier""",
}
