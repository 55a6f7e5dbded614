"""Declared schemas of the seven tables and of the write-path inputs.

Keys are ``LongType``, day counts ``IntegerType``, money ``DecimalType``.
Timestamps are ``TimestampNTZType`` holding UTC wall-clock values (the
driver's parquet files store ``timestamp_ntz``).
"""

from __future__ import annotations

from pyspark.sql import types as T

TS = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
PERCENT = T.DecimalType(5, 2)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable)
                         for name, dtype, nullable in fields])


COMPANIES = _schema(
    ("id", T.LongType(), False), ("name", T.StringType(), False),
    ("email", T.StringType(), True), ("phone", T.StringType(), True),
    ("address", T.StringType(), True),
    ("created_at", TS, False), ("updated_at", TS, False))

PACKAGES = _schema(
    ("id", T.LongType(), False), ("name", T.StringType(), False),
    ("description", T.StringType(), True), ("price", MONEY, False),
    ("duration_days", T.IntegerType(), False),
    ("features", T.ArrayType(T.StringType()), True),
    ("active", T.BooleanType(), False),
    ("created_at", TS, False), ("updated_at", TS, False))

PROMOTIONS = _schema(
    ("id", T.LongType(), False), ("name", T.StringType(), False),
    ("description", T.StringType(), True),
    ("discount_percent", PERCENT, True), ("discount_amount", MONEY, True),
    ("valid_from", TS, False), ("valid_until", TS, False),
    ("active", T.BooleanType(), False),
    ("created_at", TS, False), ("updated_at", TS, False))

PACKAGE_PROMOTIONS = _schema(
    ("id", T.LongType(), False), ("package_id", T.LongType(), False),
    ("promotion_id", T.LongType(), False))

CUSTOMERS = _schema(
    ("id", T.LongType(), False), ("first_name", T.StringType(), False),
    ("last_name", T.StringType(), False), ("email", T.StringType(), False),
    ("phone", T.StringType(), True), ("company_id", T.LongType(), True),
    ("status", T.StringType(), False), ("notes", T.StringType(), True),
    ("created_at", TS, False), ("updated_at", TS, False))

CUSTOMER_PACKAGES = _schema(
    ("id", T.LongType(), False), ("customer_id", T.LongType(), False),
    ("package_id", T.LongType(), False), ("promotion_id", T.LongType(), True),
    ("joined_at", TS, False), ("expires_at", TS, False),
    ("price_paid", MONEY, True), ("status", T.StringType(), False),
    ("created_at", TS, False), ("updated_at", TS, False))

NOTIFICATION_LOG = _schema(
    ("id", T.LongType(), False), ("type", T.StringType(), False),
    ("recipient_email", T.StringType(), False), ("subject", T.StringType(), True),
    ("sent_at", TS, False), ("customer_id", T.LongType(), True),
    ("customer_package_id", T.LongType(), True),
    ("success", T.BooleanType(), False), ("error_message", T.StringType(), True))

TABLES: dict[str, T.StructType] = {
    "companies": COMPANIES,
    "packages": PACKAGES,
    "promotions": PROMOTIONS,
    "package_promotions": PACKAGE_PROMOTIONS,
    "customers": CUSTOMERS,
    "customer_packages": CUSTOMER_PACKAGES,
    "notification_log": NOTIFICATION_LOG,
}

# Foreign keys: (child table, child column, parent table, delete rule).
FOREIGN_KEYS = [
    ("package_promotions", "package_id", "packages", "cascade"),
    ("package_promotions", "promotion_id", "promotions", "cascade"),
    ("customers", "company_id", "companies", "set_null"),
    ("customer_packages", "customer_id", "customers", "cascade"),
    ("customer_packages", "package_id", "packages", "restrict"),
    ("customer_packages", "promotion_id", "promotions", "set_null"),
    ("notification_log", "customer_id", "customers", "set_null"),
    ("notification_log", "customer_package_id", "customer_packages", "set_null"),
]

# Unique keys besides the id.
UNIQUE_KEYS = {
    "customers": [["email"]],
    "package_promotions": [["package_id", "promotion_id"]],
}

# A change row: one field-level patch or a delete, ordered by ``seq``.
# For each patchable field ``f`` there is a value ``f`` and a flag ``set_f``;
# ``set_f`` false means absent (keep), true with a NULL value means clear.
CUSTOMER_CHANGES = _schema(
    ("seq", T.LongType(), False), ("ts", TS, True), ("id", T.LongType(), False),
    ("op", T.StringType(), False),
    ("set_status", T.BooleanType(), False), ("status", T.StringType(), True),
    ("set_notes", T.BooleanType(), False), ("notes", T.StringType(), True))

# Fields each entity lets a patch or insert set (the rest are managed).
WRITABLE = {
    "companies": ["name", "email", "phone", "address"],
    "packages": ["name", "description", "price", "duration_days", "features", "active"],
    "promotions": ["name", "description", "discount_percent", "discount_amount",
                   "valid_from", "valid_until", "active"],
    "customers": ["first_name", "last_name", "email", "phone", "company_id",
                  "status", "notes"],
    # customer_id is accepted by the validator but never written by a patch.
    "customer_packages": ["package_id", "promotion_id", "joined_at", "expires_at",
                          "price_paid", "status"],
}

# Defaults of an insert for a field the request leaves out (beyond NULL).
INSERT_DEFAULTS = {
    "customers": {"status": "active"},
    "packages": {"active": True},
    "promotions": {"active": True},
    "customer_packages": {"status": "active"},
    "companies": {},
}


def conform(df, schema: T.StructType):
    """Select and cast the columns of ``schema`` in its order."""
    from pyspark.sql import functions as F
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
