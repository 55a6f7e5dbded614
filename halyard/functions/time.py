"""Clock helpers: ``as_of`` literals and day horizons as intervals."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000


def ts_text(value) -> str:
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(value, dt.date):
        return value.strftime("%Y-%m-%d 00:00:00")
    return str(value)


def at(value, dtype: T.DataType | None = None) -> Column:
    """``value`` (datetime or text, UTC) as a timestamp literal.

    The literal takes the type of the column it meets: ``timestamp_ntz`` by
    default, ``timestamp`` (read in the UTC session zone) when asked.
    """
    target = "timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz"
    return F.lit(ts_text(value)).cast(target)


def at_for(df, column: str, value) -> Column:
    return at(value, df.schema[column].dataType)


def horizon_interval(days) -> Column:
    """A number of days (may be fractional, may be a Column) as a day-time
    interval, exact to the microsecond."""
    if isinstance(days, Column):
        secs = (days.cast("decimal(20,6)") * F.lit(86400)).cast("decimal(18,6)")
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)
    micros = int((Decimal(str(days)) * MICROS_PER_DAY).to_integral_value())
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                              F.lit(Decimal(micros) / Decimal(1_000_000)).cast("decimal(18,6)"))


def shift(value, days) -> dt.datetime:
    """``value + days`` on the driver, for constant bounds that Catalyst can
    push into the scan."""
    base = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    return base + dt.timedelta(microseconds=int(
        (Decimal(str(days)) * MICROS_PER_DAY).to_integral_value()))
