"""Dashboard metrics (A1-A11), customers per company (A12), write outcome
counts (A13).

Each table is read once: one conditional-aggregate pass per table (partial
aggregation per task, then one final row), and the four single-row results
are stacked and folded into one row without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.time import at_for, shift

ACTIVE = "active"
EXPIRED = "expired"


def _long(c: Column, name: str) -> Column:
    return c.cast("bigint").alias(name)


def _expiring(cp: DataFrame, days, as_of) -> Column:
    return ((F.col("status") == ACTIVE)
            & F.col("expires_at").between(at_for(cp, "expires_at", as_of),
                                          at_for(cp, "expires_at", shift(as_of, days))))


def customer_metrics(t, as_of) -> DataFrame:
    """A1, A2, A10."""
    c = t["customers"]
    since = at_for(c, "created_at", shift(as_of, -30))
    return c.agg(_long(F.count(F.lit(1)), "total_customers"),
                 _long(F.count_if(F.col("status") == ACTIVE), "active_customers"),
                 _long(F.count_if(F.col("created_at") >= since), "new_customers_30d"))


def company_metrics(t) -> DataFrame:
    """A3."""
    return t["companies"].agg(_long(F.count(F.lit(1)), "total_companies"))


def package_metrics(t) -> DataFrame:
    """A4."""
    return t["packages"].agg(_long(F.count_if(F.col("active")), "active_packages_count"))


def subscription_metrics(t, as_of) -> DataFrame:
    """A5-A9 in one pass over the subscriptions."""
    cp = t["customer_packages"]
    active = F.col("status") == ACTIVE
    revenue = F.coalesce(F.sum(F.when(active, F.col("price_paid"))),
                         F.lit(0).cast("decimal(20,2)")).cast("double")
    return cp.agg(_long(F.count_if(active), "active_subscriptions"),
                  _long(F.count_if(_expiring(cp, 7, as_of)), "expiring_in_7_days"),
                  _long(F.count_if(_expiring(cp, 30, as_of)), "expiring_in_30_days"),
                  _long(F.count_if(F.col("status") == EXPIRED), "expired_subscriptions"),
                  revenue.alias("total_revenue"))


STAT_COLUMNS = ["total_customers", "active_customers", "total_companies",
                "active_packages_count", "active_subscriptions", "expiring_in_7_days",
                "expiring_in_30_days", "expired_subscriptions", "total_revenue",
                "new_customers_30d"]


def dashboard_stats(t, as_of) -> DataFrame:
    """A1-A10 as one row. Four one-row aggregates stacked (four rows)
    and folded with ``max``, which skips the NULLs each part leaves."""
    parts = [customer_metrics(t, as_of), company_metrics(t), package_metrics(t),
             subscription_metrics(t, as_of)]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in STAT_COLUMNS])


def customer_count(t) -> DataFrame:
    """Customers for each company, 0 when it has none. Customers are
    aggregated (map-side combined) before the join, so a company holding a
    third of all customers costs one row per map task."""
    counts = (t["customers"].where(F.col("company_id").isNotNull())
              .groupBy("company_id").agg(F.count(F.lit(1)).alias("__n")))
    comp = t["companies"].select("id")
    return (comp.join(counts, comp["id"] == counts["company_id"], "left")
            .select(F.col("id").alias("company_id"),
                    F.coalesce("__n", F.lit(0)).cast("bigint").alias("customer_count")))


def write_counts(outcomes: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """Rows changed and keys not found (and rejected) of one write."""
    o = F.col(outcome_col)
    return outcomes.agg(_long(F.count_if(o.isin("updated", "deleted", "inserted", "expired")),
                             "rows_changed"),
                        _long(F.count_if(o == "not_found"), "not_found"),
                        _long(F.count_if(o == "rejected"), "rejected"))
