"""Request bodies as JSON text: files or a stream of lines, or any text column.

A body is parsed once to VARIANT. For each field of an entity there is a value
column and ``set_<field>``, whether the body has the key, so an absent key and
an explicit null differ. What has the wrong JSON type, or is no JSON object,
is told in ``json_errors``; such rows are kept, and the validators (V1-V5)
and so every write (W2, W4, W5, W11) reject them with these codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The JSON name, the column, its type and whether null is
# allowed, for the fields of each entity's requests.
TEXT, NUMBER, WHOLE, FLAG, TEXTS = "text", "number", "whole", "flag", "texts"
FIELDS: dict[str, list[tuple[str, str, str, bool]]] = {
    "companies": [("name", "name", TEXT, False), ("email", "email", TEXT, True), ("phone", "phone", TEXT, True),
                  ("address", "address", TEXT, True)],
    "packages": [("name", "name", TEXT, False), ("description", "description", TEXT, True), ("price", "price", NUMBER, False),
                 ("durationDays", "duration_days", WHOLE, False), ("features", "features", TEXTS, True),
                 ("active", "active", FLAG, False)],
    "promotions": [("name", "name", TEXT, False), ("description", "description", TEXT, True),
                   ("discountPercent", "discount_percent", NUMBER, True), ("discountAmount", "discount_amount", NUMBER, True),
                   ("validFrom", "valid_from", TEXT, False), ("validUntil", "valid_until", TEXT, False),
                   ("active", "active", FLAG, False)],
    "customers": [("firstName", "first_name", TEXT, False), ("lastName", "last_name", TEXT, False),
                  ("email", "email", TEXT, False), ("phone", "phone", TEXT, True), ("companyId", "company_id", WHOLE, True),
                  ("status", "status", TEXT, False), ("notes", "notes", TEXT, True)],
    "customer_packages": [("customerId", "customer_id", WHOLE, False), ("packageId", "package_id", WHOLE, False),
                          ("promotionId", "promotion_id", WHOLE, True), ("joinedAt", "joined_at", TEXT, False),
                          ("expiresAt", "expires_at", TEXT, False), ("pricePaid", "price_paid", NUMBER, True),
                          ("status", "status", TEXT, False)],
}
# The subscription nested in a new customer's request.
NESTED, NESTED_FIELDS = "packageAssignment", [
    ("packageId", "package_id", WHOLE, False), ("promotionId", "promotion_id", WHOLE, True),
    ("joinedAt", "joined_at", TEXT, False), ("expiresAt", "expires_at", TEXT, False), ("pricePaid", "price_paid", NUMBER, True)]
# The bodies of a request may have so many bytes.
BODY_BYTES = 1 << 20

_SQL = {TEXT: "string", NUMBER: "double", WHOLE: "bigint", FLAG: "boolean", TEXTS: "array<string>"}


def read_bodies(spark: SparkSession, path: str, stream: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """One request a line of the text files in ``path``: ``body``."""
    if not stream:
        return spark.read.text(path).withColumnRenamed("value", "body")
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).withColumnRenamed("value", "body")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _typed(v: Column, kind: str) -> tuple[Column, Column, str]:
    """(whether ``v``, which is no JSON null, has the type, its value, the code if not)."""
    if kind == TEXT:
        return _kind(v) == "STRING", F.try_variant_get(v, "$", "string"), "string"
    if kind == FLAG:
        return _kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"), "boolean"
    if kind == TEXTS:
        each = F.try_variant_get(v, "$", "array<variant>")
        return each.isNotNull() & F.forall(each, lambda x: F.coalesce(_kind(x) == "STRING", F.lit(False))), \
            F.try_variant_get(v, "$", "array<string>"), "strings"
    number = _kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    value = F.try_variant_get(v, "$", "double")
    if kind == NUMBER:
        return number, value, "number"
    return number & (value == F.floor(value)) & (F.abs(value) < 2.0 ** 63), F.try_variant_get(v, "$", "bigint"), "integer"


def _field(body: Column, prefix: str, name: str, column: str, kind: str, nullable: bool) -> tuple[Column, Column, Column]:
    """(value, whether the key is there, error code or NULL)."""
    v = F.try_variant_get(body, f"$.{name}", "variant")
    there, null = v.isNotNull(), F.coalesce(F.is_variant_null(v), F.lit(False))
    right, value, code = _typed(v, kind)
    good = there & ~null & F.coalesce(right, F.lit(False))
    error = F.when(there & ~null & ~good, F.lit(f"{prefix}{column}:{code}"))
    if not nullable:
        error = F.when(there & null, F.lit(f"{prefix}{column}:required")).otherwise(error)
    return F.when(good, value).cast(_SQL[kind]), there, error


def parse_requests(requests: DataFrame, entity: str, partial: bool = False, body_col: str = "body") -> DataFrame:
    """``requests`` with the JSON text ``body_col`` replaced by the entity's
    columns and ``json_errors``; a projection, so it also runs on a stream.

    ``partial`` (patches) adds ``set_<field>``; without it a customer's nested
    subscription becomes the struct ``subscription``. Codes: ``body:json`` (no
    JSON, or no object), ``body:too_large``, ``<field>:<type>`` for a value of
    another JSON type and ``<field>:required`` for a null where none is
    allowed. Defined results: a NULL or empty body is an empty object; keys
    that an entity does not have are ignored; an object that repeats a key is
    no JSON; a field in error is NULL."""
    text = F.coalesce(F.when(F.trim(F.col(body_col)) != "", F.col(body_col)), F.lit("{}"))
    large = F.octet_length(text) > BODY_BYTES
    df = requests.withColumn("__body", F.when(~large, F.try_parse_json(text))).withColumn("__large", large)
    body, large = F.col("__body"), F.col("__large")
    whole = F.coalesce(_kind(body).startswith("OBJECT"), F.lit(False))
    columns, errors = [], [F.when(large, F.lit("body:too_large")).when(~whole, F.lit("body:json"))]
    for name, column, kind, nullable in FIELDS[entity]:
        value, there, error = _field(body, "", name, column, kind, nullable)
        columns.append(F.when(whole, value).alias(column))
        if partial:
            columns.append((whole & there).alias(f"set_{column}"))
        errors.append(F.when(whole, error))
    if entity == "customers" and not partial:
        sub = F.try_variant_get(body, f"$.{NESTED}", "variant")
        given = sub.isNotNull() & ~F.coalesce(F.is_variant_null(sub), F.lit(False))
        nested = given & F.coalesce(_kind(sub).startswith("OBJECT"), F.lit(False))
        parts = [_field(sub, "subscription.", *f) for f in NESTED_FIELDS]
        columns.append(F.when(whole & nested, F.struct(*[p[0].alias(f[1]) for p, f in zip(parts, NESTED_FIELDS)])).alias("subscription"))
        errors.append(F.when(whole & given & ~nested, F.lit("subscription:object")))
        errors += [F.when(whole & nested, p[2]) for p in parts]
    kept = [F.col(c) for c in requests.columns if c != body_col]
    return df.select(*kept, *columns, F.array_compact(F.array(*errors)).alias("json_errors"))


def merged_errors(errors: Column, given: Column) -> Column:
    """The codes ``given`` with a parsed body, then the rules' ``errors`` for
    its other fields; a body that is no object has its own code alone."""
    named = F.transform(given, lambda e: F.substring_index(e, ":", 1))
    others = F.filter(errors, lambda e: ~F.array_contains(named, F.substring_index(e, ":", 1)))
    return F.when(F.array_contains(named, "body"), given).otherwise(F.concat(given, others))


def to_bodies(rows: DataFrame, entity: str, body_col: str = "body") -> DataFrame:
    """``rows`` with an entity's columns written as JSON text (NULL as null)."""
    names = {c: n for n, c, _k, _ in FIELDS[entity]}
    have = [c for c in rows.columns if c in names]
    body = F.to_json(F.struct(*[F.col(c).alias(names[c]) for c in have]), {"ignoreNullFields": "false"})
    return rows.select(*[c for c in rows.columns if c not in have], body.alias(body_col))
