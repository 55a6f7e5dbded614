"""Counts that are kept with the tables instead of counted anew (A1-A12, J1),
and a histogram of expiries with prefix sums (A6, A7, F7, J5).

A count table has rows (measure, key, n, amount). What a batch changes is
told by the rows it touched, before and after: their contributions, the
first with a minus, are folded into the stored rows. The whole tables are
read once, to start.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.time import at, at_for, shift
from halyard.operators.joins import small_side
from halyard.operators.metrics import ACTIVE, EXPIRED, STAT_COLUMNS

MONEY_SUM = "decimal(38,2)"
# Seconds of a bucket of time.
HOUR = 3600


def hour_of(c: Column) -> Column:
    """The hour of a wall-clock time, counted from 1970."""
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    return (days.cast("bigint") * 24 + F.hour(c)).cast("bigint")


def hour_number(value: dt.datetime) -> int:
    return (value - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=HOUR)


def _measures(entity: str) -> list[tuple[Column, Column | str, Column | None, Column]]:
    """(condition, measure, key, amount) of what a row of ``entity`` counts in."""
    yes, no, zero = F.lit(True), F.lit(None).cast("bigint"), F.lit(0).cast(MONEY_SUM)
    status, active = F.col("status"), F.lit(ACTIVE)
    if entity == "customers":
        return [(yes, "customers", no, zero), (status == active, "customers_active", no, zero),
                (F.col("company_id").isNotNull(), "company_customers", F.col("company_id"), zero),
                (yes, "customers_created", hour_of(F.col("created_at")), zero)]
    if entity == "companies":
        return [(yes, "companies", no, zero)]
    if entity == "packages":
        return [(F.col("active"), "packages_active", no, zero)]
    if entity == "customer_packages":
        price = F.coalesce(F.col("price_paid"), F.lit(0)).cast(MONEY_SUM)
        return [(status == active, "subscriptions_active", no, price), (status == F.lit(EXPIRED), "subscriptions_expired", no, zero),
                (status == active, "expiring", hour_of(F.col("expires_at")), zero)]
    return []


def contributions(rows: DataFrame, entity: str, sign: int = 1) -> DataFrame:
    """(measure, key, n, amount) of ``rows``, summed map-side, times ``sign``."""
    found = [F.when(cond, F.struct(F.lit(m).alias("measure"), key.cast("bigint").alias("key"), amount.alias("amount")))
             for cond, m, key, amount in _measures(entity)]
    each = rows.select(F.explode(F.array(*found)).alias("c")).where("c IS NOT NULL").select("c.*")
    return each.groupBy("measure", "key").agg((F.count(F.lit(1)) * sign).alias("n"),
                                              (F.sum("amount") * sign).cast(MONEY_SUM).alias("amount"))


COUNTED = ["customers", "companies", "packages", "customer_packages"]


def initial_counts(t) -> DataFrame:
    """The count table of whole tables: one read of each."""
    return reduce(DataFrame.unionByName, [contributions(t[n], n) for n in COUNTED])


def changed_images(before: DataFrame, after: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``before`` that ``after`` has not, and the other way round:
    the two images of what a batch changed, for a caller that kept both
    tables but not the changed ids. One pass over both, by key."""
    columns = before.columns
    tagged = before.withColumn("__side", F.lit(-1)).unionByName(after.withColumn("__side", F.lit(1)))
    # A row that is in both cancels out; a key has at most one row a side.
    net = tagged.groupBy(*columns).agg(F.sum("__side").alias("__net"))
    return net.where("__net < 0").select(columns), net.where("__net > 0").select(columns)


def touched_images(before: DataFrame, after: DataFrame, ids: DataFrame, small: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with one of ``ids`` (column ``id``) before and after a batch:
    under the broadcast bound one map-only pass over each table."""
    ids = small_side(ids.select("id").distinct(), small=small)
    return before.join(ids, "id", "left_semi"), after.join(ids, "id", "left_semi")


def fold_counts(counts: DataFrame, *images: tuple[str, DataFrame | None, DataFrame | None]) -> DataFrame:
    """``counts`` after a batch, from (entity, rows before, rows after) of
    each table it changed (None: no such rows, as before an insert)."""
    parts = [counts.select("measure", "key", "n", "amount")]
    for entity, before, after in images:
        parts += [contributions(before, entity, -1)] if before is not None else []
        parts += [contributions(after, entity)] if after is not None else []
    folded = reduce(DataFrame.unionByName, parts).groupBy("measure", "key").agg(
        F.sum("n").alias("n"), F.sum("amount").cast(MONEY_SUM).alias("amount"))
    return folded.where("n <> 0 OR amount <> 0")


def _in_hour(column: str, df: DataFrame, value: dt.datetime) -> Column:
    """Whether a time lies in the hour of ``value``: a range that the scan
    can skip by."""
    start = dt.datetime(1970, 1, 1) + hour_number(value) * dt.timedelta(seconds=HOUR)
    return (F.col(column) >= at_for(df, column, start)) & (F.col(column) < at_for(df, column, start + dt.timedelta(seconds=HOUR)))


def maintained_dashboard(counts: DataFrame, t, as_of) -> DataFrame:
    """A11 from the count table: the same row as ``dashboard_stats``. Whole
    hours come from the counts; of ``customers`` and ``customer_packages``
    only the rows of the hours at the edges of the horizons are read."""
    base = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    total = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).cast("bigint")
    between = lambda m, low, high: F.coalesce(F.sum(F.when(
        (F.col("measure") == m) & (F.col("key") > low) & (F.col("key") < high), F.col("n"))), F.lit(0)).cast("bigint")
    since, far = shift(base, -30), 1 << 40
    ends = {7: shift(base, 7), 30: shift(base, 30)}
    kept = counts.agg(
        total("customers").alias("total_customers"), total("customers_active").alias("active_customers"),
        total("companies").alias("total_companies"), total("packages_active").alias("active_packages_count"),
        total("subscriptions_active").alias("active_subscriptions"), total("subscriptions_expired").alias("expired_subscriptions"),
        F.coalesce(F.sum(F.when(F.col("measure") == "subscriptions_active", F.col("amount"))), F.lit(0)).cast("double").alias("total_revenue"),
        between("customers_created", hour_number(since), far).alias("new_customers_30d"),
        *[between("expiring", hour_number(base), hour_number(end)).alias(f"expiring_in_{d}_days") for d, end in ends.items()])
    c, cp = t["customers"], t["customer_packages"]
    new = c.where(_in_hour("created_at", c, since) & (F.col("created_at") >= at_for(c, "created_at", since))).agg(
        F.count(F.lit(1)).alias("new_customers_30d"))
    edges = cp.where((F.col("status") == ACTIVE) & (_in_hour("expires_at", cp, base) | reduce(
        lambda a, b: a | b, [_in_hour("expires_at", cp, end) for end in ends.values()])))
    edge = edges.agg(*[F.count_if(F.col("expires_at").between(at_for(cp, "expires_at", base), at_for(cp, "expires_at", end))
                                  & (_in_hour("expires_at", cp, base) | _in_hour("expires_at", cp, end))).alias(f"expiring_in_{d}_days")
                       for d, end in ends.items()])
    whole = kept.unionByName(new, allowMissingColumns=True).unionByName(edge, allowMissingColumns=True)
    # Each count is in one or two of the three rows.
    return whole.agg(*[F.sum(x).alias(x) for x in STAT_COLUMNS])


def maintained_customer_count(counts: DataFrame, t) -> DataFrame:
    """A12 from the count table: customers for each company, 0 without any."""
    of = counts.where("measure = 'company_customers'").select(F.col("key").alias("__key"), "n")
    comp = t["companies"].select("id")
    return comp.join(of, comp["id"] == of["__key"], "left").select(
        F.col("id").alias("company_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("customer_count"))


# -- expiry histogram ------------------------------------------------------------------

def expiry_histogram(cp: DataFrame) -> DataFrame:
    """(hour, n, upto): active subscriptions expiring in each hour, and in it
    or before. A row for each hour that has any, whatever the table's size;
    the prefix sums run over those."""
    by_hour = (cp.where(F.col("status") == ACTIVE).groupBy(hour_of(F.col("expires_at")).alias("hour"))
               .agg(F.count(F.lit(1)).alias("n")))
    return with_prefix_sums(by_hour)


def histogram_of_counts(counts: DataFrame) -> DataFrame:
    """``expiry_histogram`` from the maintained count table."""
    return with_prefix_sums(counts.where("measure = 'expiring'").select(F.col("key").alias("hour"), "n"))


def with_prefix_sums(by_hour: DataFrame) -> DataFrame:
    upto = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return by_hour.select("hour", "n", F.sum("n").over(upto).alias("upto"))


def expiring_counts(histogram: DataFrame, cp: DataFrame, horizons: DataFrame, as_of, days_col: str = "days") -> DataFrame:
    """``horizons`` with ``expiring``: active subscriptions that expire from
    ``as_of`` to so many (also fractional) days later, both ends included.

    Whole hours are the difference of two prefix sums, as-of the hours before
    the two ends; the ends' own hours are counted from the rows of ``cp`` in
    them (cut by hour first). Those are summed by time, so however many rows
    and horizons meet in an hour, no pairs are made."""
    from halyard.functions.time import horizon_interval
    base = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    h = horizons.withColumn("__end", at(base) + horizon_interval(F.col(days_col)))
    probes = h.select("__end").distinct().unionByName(h.sparkSession.range(1).select((at(base) - F.expr("INTERVAL '0.000001' SECOND")).alias("__end")))
    probes = probes.select(F.col("__end").alias("ts"), hour_of(F.col("__end")).alias("hour")).distinct()
    hours = probes.select("hour").distinct()
    # All before the hour: the prefix sum of the last hour below it.
    order = Window.orderBy("hour", "probe").rowsBetween(Window.unboundedPreceding, -1)
    marks = histogram.select("hour", F.lit(1).alias("probe"), "upto").unionByName(
        hours.select("hour", F.lit(0).alias("probe"), F.lit(None).cast("bigint").alias("upto")))
    before = marks.withColumn("before", F.coalesce(F.last("upto", ignorenulls=True).over(order), F.lit(0))).where("probe = 0").select("hour", "before")
    # Within the hour: running counts over times, of rows and of probes.
    inside = (cp.where(F.col("status") == ACTIVE).select(F.col("expires_at").cast("timestamp_ntz").alias("ts"), hour_of(F.col("expires_at")).alias("hour"))
              .join(small_side(hours), "hour", "left_semi").groupBy("hour", "ts").agg(F.count(F.lit(1)).alias("n")))
    times = inside.unionByName(probes.select("hour", "ts", F.lit(0).cast("bigint").alias("n"))).groupBy("hour", "ts").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("hour").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    upto = (times.withColumn("within", F.sum("n").over(run)).join(probes, ["hour", "ts"], "left_semi").join(before, "hour")
            .select(F.col("ts").alias("__ts"), (F.col("before") + F.col("within")).alias("__upto")))
    low = upto.where(F.col("__ts") == at(base) - F.expr("INTERVAL '0.000001' SECOND")).select(F.col("__upto").alias("__low"))
    out = h.join(upto, F.col("__end") == F.col("__ts"), "left").join(F.broadcast(low))
    n = F.when(F.col("__end") >= at(base), F.col("__upto") - F.col("__low")).otherwise(0)
    return out.select(*horizons.columns, F.coalesce(n, F.lit(0)).cast("bigint").alias("expiring"))
