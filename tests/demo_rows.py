"""The reference's demo rows at a fixed clock ``T`` (FIXTURES.md Part A)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from halyard.session import AS_OF
from halyard.sources import schemas as S

T = AS_OF


def d(days: float) -> dt.datetime:
    return T + dt.timedelta(days=days)


def demo_tables(spark):
    companies = [(i + 1, n, None, None, None, T, T) for i, n in
                 enumerate(["Acme Corp", "Globex Inc", "Initech Ltd", "Umbrella Co"])]
    packages = [
        (1, "Basic", None, Decimal("29.00"), 30,
         ["Up to 5 users", "Email support", "1 GB storage"], True, T, T),
        (2, "Professional", None, Decimal("79.00"), 30,
         ["Up to 25 users", "Priority support", "20 GB storage", "API access"], True, T, T),
        (3, "Enterprise", None, Decimal("199.00"), 30,
         ["Unlimited users", "24/7 support", "Unlimited storage", "API access", "SLA"], True, T, T),
    ]
    promotions = [
        (1, "Summer Sale", None, Decimal("20.00"), None, d(-10), d(20), True, T, T),
        (2, "New Customer", None, Decimal("10.00"), None, d(-60), d(60), True, T, T),
    ]
    customers = [
        (1, "Alice", "Johnson", "alice@acme.com", "+1-555-1001", 1, "active", "VIP client", T, T),
        (2, "Bob", "Smith", "bob@globex.com", "+1-555-1002", 2, "active", None, T, T),
        (3, "Carol", "Williams", "carol@initech.com", "+1-555-1003", 3, "active",
         "Renewal due soon", T, T),
        (4, "David", "Brown", "david@umbrella.com", "+1-555-1004", 4, "inactive", None, T, T),
        (5, "Eve", "Davis", "eve@freelance.com", "+1-555-1005", None, "active", None, T, T),
        (6, "Frank", "Miller", "frank@acme.com", "+1-555-1006", 1, "churned", None, T, T),
    ]
    subs = [
        (1, 1, 3, None, d(-5), d(25), Decimal("199.00"), "active", T, T),
        (2, 2, 2, None, d(-25), d(5), Decimal("79.00"), "active", T, T),
        (3, 3, 1, None, d(-28), d(2), Decimal("29.00"), "active", T, T),
        (4, 5, 2, 1, d(-10), d(20), Decimal("63.20"), "active", T, T),
        (5, 6, 1, None, d(-60), d(-30), Decimal("29.00"), "expired", T, T),
    ]
    log = [(1, "package_expiry", "admin@example.com", "Package Expiry Alert - 7 day horizon",
            d(-1), None, 2, True, None)]
    pp = [(1, 2, 1), (2, 3, 2)]
    rows = {"companies": companies, "packages": packages, "promotions": promotions,
            "package_promotions": pp, "customers": customers, "customer_packages": subs,
            "notification_log": log}
    return {name: spark.createDataFrame(r, S.TABLES[name]) for name, r in rows.items()}
