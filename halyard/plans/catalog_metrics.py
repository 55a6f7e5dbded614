"""Registered metrics."""

from __future__ import annotations

from halyard.operators.replay import replay_changes
from halyard.operators import metrics as M
from halyard.plans.catalog import AS_OF, register

ACTIVE_EXPIRING = ("status = 'active' AND expires_at BETWEEN {AS_OF} "
                   "AND {AS_OF} + INTERVAL '%d' DAY")

METRIC_SQL = {
    "total_customers": "SELECT CAST(count(*) AS BIGINT) AS total_customers FROM customers",
    "active_customers": "SELECT CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) "
                        "AS active_customers FROM customers",
    "total_companies": "SELECT CAST(count(*) AS BIGINT) AS total_companies FROM companies",
    "active_packages_count": "SELECT CAST(count(*) FILTER (WHERE active) AS BIGINT) "
                             "AS active_packages_count FROM packages",
    "active_subscriptions": "SELECT CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) "
                            "AS active_subscriptions FROM customer_packages",
    "expiring_in_7_days": "SELECT CAST(count(*) FILTER (WHERE " + ACTIVE_EXPIRING % 7
                          + ") AS BIGINT) AS expiring_in_7_days FROM customer_packages",
    "expiring_in_30_days": "SELECT CAST(count(*) FILTER (WHERE " + ACTIVE_EXPIRING % 30
                           + ") AS BIGINT) AS expiring_in_30_days FROM customer_packages",
    "expired_subscriptions": "SELECT CAST(count(*) FILTER (WHERE status = 'expired') AS BIGINT) "
                             "AS expired_subscriptions FROM customer_packages",
    "total_revenue": "SELECT CAST(coalesce(sum(price_paid) FILTER (WHERE status = 'active'), 0) "
                     "AS DOUBLE) AS total_revenue FROM customer_packages",
    "new_customers_30d": "SELECT CAST(count(*) FILTER (WHERE created_at >= {AS_OF} - "
                         "INTERVAL '30' DAY) AS BIGINT) AS new_customers_30d FROM customers",
}

SOURCE = {
    "total_customers": lambda t: M.customer_metrics(t, AS_OF),
    "active_customers": lambda t: M.customer_metrics(t, AS_OF),
    "new_customers_30d": lambda t: M.customer_metrics(t, AS_OF),
    "total_companies": M.company_metrics,
    "active_packages_count": M.package_metrics,
}


def _metric(name: str):
    def run(t):
        src = SOURCE.get(name, lambda tt: M.subscription_metrics(tt, AS_OF))
        return src(t).select(name)
    run.__doc__ = f"A: {name}, one row."
    return run


for _name in M.STAT_COLUMNS:
    register(_name, METRIC_SQL[_name])(_metric(_name))


@register("dashboard_stats", "SELECT * FROM " + ", ".join(
    f"({METRIC_SQL[n]}) AS m{i}" for i, n in enumerate(M.STAT_COLUMNS)))
def _dashboard_stats(t):
    """The ten dashboard metrics as one row."""
    return M.dashboard_stats(t, AS_OF)


@register("customer_count", """
SELECT co.id AS company_id, CAST(count(c.id) AS BIGINT) AS customer_count
FROM companies co LEFT JOIN customers c ON c.company_id = co.id
GROUP BY co.id""")
def _customer_count(t):
    """Customers per company, 0 when none."""
    return M.customer_count(t)


@register("write_counts", """
WITH ch AS (
  SELECT h.id, c.id AS found, h.op, set_status AND h.status NOT IN ('active', 'inactive', 'churned') AS broken,
         d.seq IS NOT NULL AND h.seq > d.seq AS late
  FROM customer_changes h LEFT JOIN customers c ON c.id = h.id
  LEFT JOIN (SELECT id, min(seq) AS seq FROM customer_changes WHERE op = 'delete' GROUP BY id) d ON d.id = h.id)
SELECT CAST(count(*) FILTER (WHERE NOT broken AND found IS NOT NULL AND NOT late) AS BIGINT) AS rows_changed,
       CAST(count(*) FILTER (WHERE NOT broken AND (found IS NULL OR late)) AS BIGINT) AS not_found,
       CAST(count(*) FILTER (WHERE broken) AS BIGINT) AS rejected
FROM ch""")
def _write_counts(t):
    """The changes of the feed that took effect, found no row or were
    rejected, replayed one after the other."""
    _new, outcomes = replay_changes(t, t["customer_changes"], "customers", AS_OF)
    return M.write_counts(outcomes)
