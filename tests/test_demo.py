"""Hand-checked results on the reference's demo rows (FIXTURES.md Part A)."""

from halyard.operators import lifecycle as L
from halyard.operators import metrics as M
from halyard.operators import views as V
from tests.demo_rows import T, d


def test_dashboard_stats(demo):
    row = M.dashboard_stats(demo, T).first().asDict()
    assert row == {"total_customers": 6, "active_customers": 4, "total_companies": 4,
                   "active_packages_count": 3, "active_subscriptions": 4,
                   "expiring_in_7_days": 2, "expiring_in_30_days": 4,
                   "expired_subscriptions": 1, "total_revenue": 370.2,
                   "new_customers_30d": 6}


def test_company_list(demo):
    rows = [(r["name"], r["customer_count"]) for r in V.company_list(demo).collect()]
    assert rows == [("Acme Corp", 2), ("Globex Inc", 1), ("Initech Ltd", 1), ("Umbrella Co", 1)]


def test_customer_360(demo):
    rows = {r["first_name"]: r["cp_id"] for r in V.customer_360(demo).collect()}
    assert len(rows) == 6
    assert rows["David"] is None and rows["Frank"] is None
    assert rows["Alice"] == 1 and rows["Eve"] == 4


def test_expiring_within_7(demo):
    rows = [r["customer_name"] for r in V.expiring_within(demo, 7, T).collect()]
    assert rows == ["Carol Williams", "Bob Smith"]


def test_reminder_candidates_days_left(demo):
    rows = [(r["customer_name"], r["days_left"], r["price_paid"])
            for r in V.reminder_candidates(demo, 7, T).collect()]
    assert rows == [("Carol Williams", 2, "29.00"), ("Bob Smith", 5, "79.00")]


def test_auto_expire(demo):
    cp = demo["customer_packages"]
    assert L.auto_expire_count(cp, T).first()[0] == 0
    later = d(3)
    assert L.auto_expire_count(cp, later).first()[0] == 1
    out = L.auto_expire(cp, later)
    carol = out.where("id = 3").first()
    assert carol["status"] == "expired" and carol["updated_at"] == later
    # Idempotent: a second run changes nothing.
    assert L.auto_expire_count(out, later).first()[0] == 0


def test_reminder_cycle_and_digest(demo):
    run = L.reminder_cycle(demo, 7, "admin@example.com", T)
    s = run["summary"].first().asDict()
    assert s == {"auto_expired": 0, "email_prepared": True, "reason": None, "recipients": 2,
                 "admin_email": "admin@example.com"}
    lines = run["digest"].where("section = 'text'").orderBy("part", "expires_at", "line_key")
    text = "\n".join(r["line"] for r in lines.collect())
    assert text.startswith("⚠️ CRM Alert: 2 subscription(s) expiring within 7 days\n\n")
    assert "• Carol Williams <carol@initech.com> — Basic — expires " in text
    assert "(2d left)" in text and "(5d left)" in text
    html = [r["line"] for r in run["digest"].where("section = 'html' AND part = 1")
            .orderBy("expires_at").collect()]
    assert 'class="urgent">2d' in html[0] and 'class="warning">5d' in html[1]
    log = run["log_rows"].orderBy("id").collect()
    assert [r["customer_package_id"] for r in log] == [3, 2]
    assert [r["id"] for r in log] == [2, 3]
    assert log[0]["subject"] == "Package Expiry Alert - 7 day horizon"


def test_reminder_cycle_nothing_expiring(demo):
    s = L.reminder_cycle(demo, 1, "admin@example.com", T)["summary"].first()
    assert s["reason"] == "nothing_expiring" and not s["email_prepared"] and s["recipients"] == 0


def test_boundaries(demo, spark):
    cp = demo["customer_packages"]
    # expires_at == as_of: expiring yes, expired no.
    at_t = L.auto_expire_count(cp, d(2)).first()[0]
    assert at_t == 0
    assert [r["id"] for r in V.expiring_within(demo, 0, d(2)).collect()] == [3]
    # expires_at == as_of + days: included.
    assert [r["id"] for r in V.expiring_within(demo, 2, T).collect()] == [3]
    # A negative horizon gives no rows; a fractional one is exact.
    assert V.expiring_within(demo, -1, T).count() == 0
    assert [r["id"] for r in V.expiring_within(demo, 4.99, T).collect()] == [3]
