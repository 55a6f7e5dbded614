"""SQL oracle text: fixture views as CTEs, cast to the declared column types.

The DuckDB oracle sees only the raw driver tables, so every oracle query is
prefixed with the views it reads, each wrapped in the declared schema so both
engines return the same column types.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from halyard.sources import schemas as S
from halyard.sources.fixtures import DIRTY_REQUEST_SCHEMAS, FIXTURE_SQL

AS_OF_SQL = "TIMESTAMP '2001-08-01 12:00:00'"


def duck_type(dtype) -> str:
    if isinstance(dtype, str):
        return {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
                "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "int": "INTEGER"}[dtype]
    if isinstance(dtype, T.LongType):
        return "BIGINT"
    if isinstance(dtype, T.IntegerType):
        return "INTEGER"
    if isinstance(dtype, T.StringType):
        return "VARCHAR"
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return "TIMESTAMP"
    if isinstance(dtype, T.DoubleType):
        return "DOUBLE"
    if isinstance(dtype, T.ArrayType):
        return duck_type(dtype.elementType) + "[]"
    raise TypeError(dtype)


def _fields(name):
    if name in S.TABLES:
        return [(f.name, f.dataType) for f in S.TABLES[name]]
    if name == "customer_changes":
        return [(f.name, f.dataType) for f in S.CUSTOMER_CHANGES]
    if name in DIRTY_REQUEST_SCHEMAS:
        return DIRTY_REQUEST_SCHEMAS[name]
    return None


def view_sql(name: str) -> str:
    fields = _fields(name)
    body = FIXTURE_SQL[name].strip()
    if fields is None:
        return body
    cols = ", ".join(f"CAST({n} AS {duck_type(d)}) AS {n}" for n, d in fields)
    return f"SELECT {cols} FROM ({body}) AS v"


def with_views(query: str) -> str:
    """Prefix ``query`` with the fixture views it names."""
    q = query.strip().replace("{AS_OF}", AS_OF_SQL)
    used = [n for n in FIXTURE_SQL if re.search(rf"\b{n}\b", q)]
    ctes = [f"{n} AS ({view_sql(n)})" for n in used]
    for head in ("WITH RECURSIVE ", "WITH "):
        if q.startswith(head):
            return head + ",\n".join([*ctes, q[len(head):]])
    if not ctes:
        return q
    return "WITH " + ",\n".join(ctes) + "\n" + q
