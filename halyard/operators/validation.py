"""Request validation (V1-V5): ``validate_<entity>(df) -> (valid, rejected)``.

Every rule is a Column expression that yields an error code or NULL; the
codes of a row are gathered in ``errors`` (array<string>, declared order),
so a batch of any size is checked in one projection with no shuffle.
Full mode (inserts) requires the required fields; partial mode (patches)
checks only the fields whose ``set_<field>`` flag is true, or, when a batch
has no flags, the non-NULL ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.sources.requests import merged_errors

# The request grammars the validators accept.
# An e-mail: a name, one @ and a domain. The name has letters, digits and
# _ ' + - . only; it does not start with a dot, hold two in a row or end with a
# dot or '. The domain has two or more labels between dots: of letters, digits
# and hyphens, not starting with a hyphen, and last one of two or more letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
NAME_CHARACTERS, LABEL_CHARACTERS = LETTERS + DIGITS + "_'+-.", LETTERS + DIGITS + "-"
# A UTC date-time: yyyy-MM-ddTHH:mm:ss, an optional fraction, then Z (no offset);
# whether the date is one of the calendar is asked of the date itself.
DATETIME_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?Z$"
# The largest values of the columns NUMERIC(10,2) and INT (fixed values).
MAX_MONEY, MAX_INT = 99_999_999.99, 2_147_483_647
CUSTOMER_STATUSES = ["active", "inactive", "churned"]
SUBSCRIPTION_STATUSES = ["active", "expired", "cancelled"]


def _c(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def _err(cond: Column, code: str) -> Column:
    return F.when(cond, F.lit(code))


def _only(s: Column, characters: str) -> Column:
    return F.translate(s, characters, "") == ""


def is_email(s: Column) -> Column:
    name, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    last = F.substring_index(domain, ".", -1)
    one = F.length(s) - F.length(F.replace(s, F.lit("@"))) == 1
    named = ((name != "") & _only(name, NAME_CHARACTERS) & ~name.startswith(".") & ~name.contains("..")
             & ~name.endswith(".") & ~name.endswith("'"))
    placed = (domain.contains(".") & _only(domain, LABEL_CHARACTERS + ".") & ~domain.startswith(".") & ~domain.contains("..")
              & ~domain.startswith("-") & ~domain.contains(".-") & (F.length(last) >= 2) & _only(last, LETTERS))
    return one & named & placed


def is_utc_datetime(s: Column) -> Column:
    """The grammar above: a real calendar date (no 30 February), UTC."""
    return s.rlike(DATETIME_SHAPE) & F.substring(s, 1, 10).try_cast("date").isNotNull()


def parse_utc_datetime(s) -> Column:
    """A valid UTC date-time text as a timestamp_ntz (UTC wall clock)."""
    s = _c(s)
    body = F.regexp_replace(F.regexp_replace(s, "Z$", ""), "T", " ")
    # A cast to timestamp_ntz reads the wall clock as written, whatever the
    # session time zone.
    return F.when(is_utc_datetime(s), body.try_cast("timestamp_ntz"))


class Rules:
    """Builds the rule list of one entity for full or partial mode."""

    def __init__(self, df: DataFrame, partial: bool):
        self.df, self.partial, self.rules = df, partial, []

    def present(self, field: str) -> Column:
        flag = f"set_{field}"
        if flag in self.df.columns:
            return F.col(flag)
        if self.partial:
            return F.col(field).isNotNull()
        return F.lit(True)

    def _add(self, field: str, cond: Column, code: str):
        if field not in self.df.columns:
            return
        self.rules.append(_err(self.present(field) & F.coalesce(cond, F.lit(False)),
                               f"{field}:{code}"))

    def _absent(self, field: str, required: bool) -> bool:
        """Whether the batch lacks the column; if it must not, every row fails."""
        if field in self.df.columns:
            return False
        if required and not self.partial:
            self.rules.append(F.lit(f"{field}:required"))
        return True

    def not_null(self, field: str):
        """A defaulted column: it may be left out, but a patch can't clear it."""
        if self.partial and field in self.df.columns:
            self._add(field, F.col(field).isNull(), "required")

    def text(self, field, lo=None, hi=None, required=False, email=False, datetime=False):
        if self._absent(field, required):
            return
        v = F.col(field)
        if required:
            self._add(field, v.isNull(), "required")
        if lo is not None:
            self._add(field, v.isNotNull() & (F.length(v) < lo), "too_short")
        if hi is not None:
            self._add(field, v.isNotNull() & (F.length(v) > hi), "too_long")
        if email:
            self._add(field, v.isNotNull() & ~is_email(v), "email")
        if datetime:
            self._add(field, v.isNotNull() & ~is_utc_datetime(v), "datetime")

    def number(self, field, lo=None, hi=None, integer=False, required=False):
        if self._absent(field, required):
            return
        v = F.col(field)
        if required:
            self._add(field, v.isNull(), "required")
        if integer:
            self._add(field, v.isNotNull() & (v.cast("double") != F.floor(v.cast("double"))),
                      "integer")
        if lo is not None:
            self._add(field, v.isNotNull() & (v < F.lit(lo)), "too_small")
        if hi is not None:
            self._add(field, v.isNotNull() & (v > F.lit(hi)), "too_big")

    def enum(self, field, values):
        if field not in self.df.columns:
            return
        v = F.col(field)
        self._add(field, v.isNotNull() & ~v.isin(values), "enum")

    def error_text(self) -> DataFrame:
        """The rows with ``error_text``: their codes ``|``-joined, or ''.
        concat_ws skips NULLs and stays in whole-stage codegen (a lambda
        over an array would not); codes hold no ``|``."""
        text = F.concat_ws("|", *self.rules) if self.rules else F.lit("")
        return self.df.withColumn("error_text", text)

    def checked(self) -> DataFrame:
        e = F.col("error_text")
        errors = F.when(e == "", F.array().cast("array<string>")).otherwise(F.split(e, r"\|"))
        if "json_errors" in self.df.columns:
            errors = merged_errors(errors, F.col("json_errors"))
        return self.error_text().withColumn("errors", errors).drop("error_text", "json_errors")

    def split(self) -> tuple[DataFrame, DataFrame]:
        checked = self.checked()
        return (checked.where(F.size("errors") == 0).drop("errors"),
                checked.where(F.size("errors") > 0))


def _has(df, field):
    return field in df.columns


def validate_companies(df: DataFrame, partial: bool = False, checked_only: bool = False):
    """V1: name 1..200; e-mail format (and the 200 column limit); phone <= 50;
    address <= 1000."""
    r = Rules(df, partial)
    r.text("name", 1, 200, required=True)
    r.text("email", hi=200, email=True)
    r.text("phone", hi=50)
    r.text("address", hi=1000)
    return r if checked_only else r.split()


def validate_packages(df: DataFrame, partial: bool = False, checked_only: bool = False):
    """V2: name 1..100; description <= 2000; price >= 0; duration_days an
    integer >= 1 (features and active are typed by the schema)."""
    r = Rules(df, partial)
    r.text("name", 1, 100, required=True)
    r.text("description", hi=2000)
    r.number("price", lo=0, hi=MAX_MONEY, required=True)
    r.number("duration_days", lo=1, hi=MAX_INT, integer=True, required=True)
    r.not_null("active")
    return r if checked_only else r.split()


def validate_promotions(df: DataFrame, partial: bool = False, checked_only: bool = False):
    """V3: name 1..200; description <= 2000; percent 0..100; amount >= 0;
    valid_from and valid_until UTC date-times (their order is not checked)."""
    r = Rules(df, partial)
    r.text("name", 1, 200, required=True)
    r.text("description", hi=2000)
    r.number("discount_percent", lo=0, hi=100)
    r.number("discount_amount", lo=0, hi=MAX_MONEY)
    r.text("valid_from", required=True, datetime=True)
    r.text("valid_until", required=True, datetime=True)
    return r if checked_only else r.split()


def validate_customers(df: DataFrame, partial: bool = False, checked_only: bool = False):
    """V4: names 1..100; e-mail format and <= 200; phone <= 50; company_id an
    integer; status in the enumeration; notes <= 2000; and, when the row
    carries a nested ``subscription``, V5's rules on it (both or neither)."""
    r = Rules(df, partial)
    r.text("first_name", 1, 100, required=True)
    r.text("last_name", 1, 100, required=True)
    r.text("email", hi=200, required=True, email=True)
    r.text("phone", hi=50)
    if _has(df, "company_id"):
        r.number("company_id", integer=True)
    r.enum("status", CUSTOMER_STATUSES)
    r.not_null("status")
    if _has(df, "notes"):
        r.text("notes", hi=2000)
    if _has(df, "subscription") and not partial:
        s = F.col("subscription")
        present = s.isNotNull()
        for cond, code in [
            (s["package_id"].isNull(), "subscription.package_id:required"),
            (s["joined_at"].isNotNull() & ~is_utc_datetime(s["joined_at"]),
             "subscription.joined_at:datetime"),
            (s["expires_at"].isNull(), "subscription.expires_at:required"),
            (s["expires_at"].isNotNull() & ~is_utc_datetime(s["expires_at"]),
             "subscription.expires_at:datetime"),
            (s["price_paid"].isNotNull() & (s["price_paid"] < 0),
             "subscription.price_paid:too_small"),
            (s["price_paid"].isNotNull() & (s["price_paid"] > MAX_MONEY),
             "subscription.price_paid:too_big"),
        ]:
            r.rules.append(_err(present & F.coalesce(cond, F.lit(False)), code))
    return r if checked_only else r.split()


def validate_subscriptions(df: DataFrame, partial: bool = False, checked_only: bool = False):
    """V5: customer and package ids required integers, promotion optional;
    joined_at optional and expires_at required UTC date-times; price >= 0;
    status in the enumeration."""
    r = Rules(df, partial)
    r.number("customer_id", integer=True, required=True)
    r.number("package_id", integer=True, required=True)
    if _has(df, "promotion_id"):
        r.number("promotion_id", integer=True)
    if _has(df, "joined_at"):
        r.text("joined_at", datetime=True)
    r.text("expires_at", required=True, datetime=True)
    r.number("price_paid", lo=0, hi=MAX_MONEY)
    r.enum("status", SUBSCRIPTION_STATUSES)
    r.not_null("status")
    r.not_null("joined_at")
    return r if checked_only else r.split()


VALIDATORS = {
    "companies": validate_companies,
    "packages": validate_packages,
    "promotions": validate_promotions,
    "customers": validate_customers,
    "customer_packages": validate_subscriptions,
}


def validation_report(df: DataFrame, entity: str, key: str = "row_id") -> DataFrame:
    """Every request row with ``valid`` and its error codes (``|``-joined)."""
    rules = VALIDATORS[entity](df, checked_only=True)
    if "json_errors" in df.columns:
        checked = rules.checked().withColumn("error_text", F.concat_ws("|", "errors"))
    else:
        checked = rules.error_text()
    return checked.select(key, (F.col("error_text") == "").alias("valid"),
                          F.col("error_text").alias("errors"))
