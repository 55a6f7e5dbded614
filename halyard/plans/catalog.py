"""The registry of named queries: one per operator key of the inventory.

Each entry takes ``(spark, sf_dir)``, builds the fixture tables over the
driver's parquet files and returns a lazy DataFrame whose column names match
the SQL oracle in ``SQL``. Decimals leave as double and arrays as ``|``-joined
text, so both engines produce comparable values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.session import AS_OF
from halyard.sources.fixtures import fixture_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Money to double, arrays to ``|``-joined text."""
    cols = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(cols)


def register(key: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(fixture_tables(spark, sf_dir)))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn
    return wrap


from halyard.plans import catalog_reads  # noqa: E402,F401  (registers keys)
from halyard.plans import catalog_metrics  # noqa: E402,F401
from halyard.plans import catalog_expressions  # noqa: E402,F401
from halyard.plans import catalog_writes  # noqa: E402,F401
