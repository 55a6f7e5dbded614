"""Output records (P1-P5): the row shapes the reference returns, with money
as double, NULL features as an empty list and zero counts for no match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.expressions import full_name, money


def company_record(df: DataFrame) -> DataFrame:
    """Nullable text kept, missing ``customer_count`` read as 0."""
    count = (F.coalesce(F.col("customer_count"), F.lit(0)) if "customer_count" in df.columns
             else F.lit(0)).cast("bigint")
    return df.select("id", "name", "email", "phone", "address",
                     count.alias("customer_count"), "created_at", "updated_at")


def package_record(df: DataFrame) -> DataFrame:
    """Price as double, NULL features as an empty array."""
    return df.select(
        "id", "name", "description", money("price").alias("price"), "duration_days",
        F.coalesce("features", F.array().cast("array<string>")).alias("features"),
        "active", "created_at", "updated_at")


def promotion_record(df: DataFrame) -> DataFrame:
    """Percent and amount as double or NULL."""
    return df.select(
        "id", "name", "description", money("discount_percent").alias("discount_percent"),
        money("discount_amount").alias("discount_amount"), "valid_from", "valid_until",
        "active", "created_at", "updated_at")


CUSTOMER_FIELDS = ["id", "first_name", "last_name", "email", "phone", "status", "notes",
                   "company_id", "company_name", "created_at", "updated_at", "cp_id",
                   "package_id", "package_name", "joined_at", "expires_at", "cp_status",
                   "price_paid", "promotion_id", "promotion_name"]


def customer_record(df: DataFrame) -> DataFrame:
    """The 20-field customer row with its current subscription."""
    return df.select([money(c).alias(c) if c == "price_paid" else F.col(c)
                      for c in CUSTOMER_FIELDS])


def subscription_record(df: DataFrame) -> DataFrame:
    """P5: the 14-field subscription row."""
    return df.select(
        "id", "customer_id", full_name("first_name", "last_name").alias("customer_name"),
        F.col("email").alias("customer_email"), "package_id", "package_name",
        "promotion_id", "promotion_name", "joined_at", "expires_at",
        money("price_paid").alias("price_paid"), "status", "created_at", "updated_at")
