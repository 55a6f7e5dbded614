"""Join helpers: a broadcast that is taken only behind a measured size bound.

A side is broadcast only when the table it comes from has at most
``BROADCAST_MAX_ROWS`` rows and its own columns hold at most
``BROADCAST_MAX_BYTES``, both taken anew for each plan: the rows from the
file footers of a parquet table, the bytes by one aggregate that is run only
under the row bound, and only where a column's width varies. Beyond the
bounds the join stays a shuffle join, and AQE may still turn it into a
broadcast from the measured shuffle size, or split skewed partitions.

Measuring runs jobs while the plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20

FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)
# Bytes of a row and of each of its values besides what a text holds.
ROW_BYTES, VALUE_BYTES = 16, 16


def row_count(df: DataFrame) -> int:
    """Row count of ``df`` as it is now: a table that grew past the bound
    since the last call is not taken for small."""
    return df.count()


def _varying_bytes(df: DataFrame) -> Column | None:
    """The bytes of a row's texts, arrays and structs (these by their text
    form); None when every column has a fixed width."""
    parts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType))
                                       else F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)).cast("bigint")
             for f in df.schema if not isinstance(f.dataType, FIXED_WIDTH)]
    return reduce(lambda x, y: x + y, parts) if parts else None


def measured_bytes(df: DataFrame, rows: int | None = None) -> int:
    """About the bytes that ``df`` holds, by one aggregate; with ``rows``, a
    bound of its rows, frames of fixed width need none."""
    each = ROW_BYTES + VALUE_BYTES * len(df.columns)
    varying = _varying_bytes(df)
    if varying is None and rows is not None:
        return rows * each
    got = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.lit(0).cast("bigint") if varying is None else varying).alias("b")).first()
    return got["n"] * each + int(got["b"] or 0)


def is_small(df: DataFrame, base: DataFrame | None = None, max_rows: int | None = None) -> bool:
    """Whether ``df``, whose rows are no more than those of ``base`` (default
    ``df``), is under both broadcast bounds."""
    bound = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    if bound < 0:
        return False
    rows = row_count(df if base is None else base)
    return rows <= bound and measured_bytes(df, rows) <= BROADCAST_MAX_BYTES


def small_side(df: DataFrame, base: DataFrame | None = None,
               max_rows: int | None = None, small: bool | None = None) -> DataFrame:
    """``broadcast(df)`` when it is under the bounds (see ``is_small``;
    ``small`` says so when already known), else ``df`` unchanged."""
    if small is None:
        small = is_small(df, base, max_rows)
    return F.broadcast(df) if small else df


def spread_nulls(fk: str | Column, own: str | Column = "id") -> Column:
    """``fk`` as the key of a LEFT join with a parent's id: where it is NULL
    a negative number made of the row's own id, which no parent has (ids are
    0 or more). So rows without a reference don't meet in one partition of a
    shuffle join."""
    fk, own = (F.col(c) if isinstance(c, str) else c for c in (fk, own))
    return F.coalesce(fk, -F.abs(own) - 1)


def present_in(batch: DataFrame, table: DataFrame, on: list[str],
               small: bool | None = None) -> DataFrame:
    """The distinct key tuples of ``batch`` (columns ``on``) that ``table``
    (same column names) holds.

    When the batch's keys are under the bound, the table is semi-joined
    against the broadcast keys: one map-only pass over the table, which is
    never shuffled, and the result (no larger than the batch) is broadcast
    in turn. Otherwise both sides shuffle on the key. Either way a key the
    table holds many times is combined map-side before the final distinct.
    ``small`` passes a bound already known (e.g. the count of the batch the
    keys come from); without it the distinct keys are counted.
    """
    from halyard.operators.integrity import all_present
    keys = batch.select(*on).where(all_present(on)).distinct()
    if small is None:
        small = is_small(keys)
    hit = table.select(*on).join(F.broadcast(keys) if small else keys, on, "left_semi").distinct()
    return F.broadcast(hit) if small else hit


# A key is heavy if it has one row in so many; there are no more heavy keys than that.
HEAVY_SHARE = 1000


def heavy_keys(df: DataFrame, key: str, share: int = HEAVY_SHARE) -> DataFrame:
    """``(key)``: the non-NULL values of ``key`` that at least one row in
    ``share`` of ``df`` holds, so at most ``share`` of them. Counted map-side
    first."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") * share >= row_count(df)).select("key")


def dimension_join(left: DataFrame, dim: DataFrame, key: str, how: str = "left", dim_key: str = "id",
                   base: DataFrame | None = None, small: bool | None = None, share: int = HEAVY_SHARE) -> DataFrame:
    """``left`` joined (``left`` or ``inner``) with the dimension ``dim`` on
    ``key`` = its unique ``dim_key``; dim's other columns are added.

    A dimension under the bounds is broadcast. Beyond them the rows of the
    keys that are heavy in ``left`` (see ``heavy_keys``) are broadcast, should
    they be under the bounds, and the others are cut to the keys in use and
    joined by a shuffle, in which rows with a heavy or a NULL key are spread
    by a hash of the row. So no task holds a heavy key, however few keys there
    are, and ``left`` is read once more, for its key counts, while the plan is
    built."""
    if small is None:
        small = is_small(dim, base)
    names = [c for c in dim.columns if c != dim_key]
    k = "__dim_key"
    if small:
        d = F.broadcast(dim.select(F.col(dim_key).alias(k), *names))
        on = F.col(key) == F.col(k)
        return left.join(d, on, how).drop(k)
    keys = [r["key"] for r in heavy_keys(left, key, share).collect()]       # at most ``share`` numbers
    top = small_side(dim.where(F.col(dim_key).isin(keys)).select(F.col(dim_key).alias("__top"), F.struct(*names).alias("__top_row")))
    used = left.select(F.col(key).alias("__used")).where("__used IS NOT NULL").distinct()
    rest = dim.join(used, dim[dim_key] == used["__used"], "left_semi").select(
        F.col(dim_key).cast("bigint").alias(k), F.struct(*names).alias("__row"))
    rows = left.join(top, F.col(key) == F.col("__top"), "left")
    own = F.when(~F.col(key).isin(keys), F.col(key).cast("bigint"))     # a heavy key without a row is spread, too
    spread = F.coalesce(own, -F.abs(F.xxhash64(*left.columns).bitwiseAND((1 << 62) - 1)) - 1)
    rows = rows.withColumn("__spread", spread).join(rest, F.col("__spread") == F.col(k), "left")
    if how == "inner":
        rows = rows.where(F.col("__top").isNotNull() | F.col(k).isNotNull())
    found = F.coalesce("__top_row", "__row")
    return rows.select(*left.columns, *[found[n].alias(n) for n in names])
