
from decimal import Decimal

from halyard.operators import changes as CH
from halyard.operators import views as V
from halyard.sources import schemas as S
from halyard.sources.fixtures import overlay
from tests.demo_rows import T, d


def test_current_subscription_tie_takes_higher_id(demo, spark):
    extra = spark.createDataFrame(
        [(6, 1, 2, None, d(-1), d(25), Decimal("79.00"), "active", T, T),      # ties Alice's
         (7, 1, 1, None, d(-1), d(40), Decimal("29.00"), "cancelled", T, T)],  # later, not active
        S.CUSTOMER_PACKAGES)
    t = overlay(demo, customer_packages=demo["customer_packages"].unionByName(extra))
    cur = {r["customer_id"]: r["id"] for r in V.current_subscription(t).collect()}
    assert cur[1] == 6


def test_search_wildcards_and_escapes(demo):
    view = V.customer_360(demo)
    names = lambda s: sorted(r["first_name"] for r in V.filter_customers(view, search=s).collect())
    assert names("ACME") == ["Alice", "Frank"]             # case-insensitive, on e-mail
    assert names("b_b") == ["Bob"]                         # _ matches one character
    assert names("a%e") == ["Alice", "Carol", "David", "Eve", "Frank"]  # % spans characters
    assert names("%") == ["Alice", "Bob", "Carol", "David", "Eve", "Frank"]
    assert names("\\%") == []                              # an escaped % is literal
    assert names("") == names("%")                         # empty means no filter
    assert V.like_term("a\\b") == "%ab%"                   # backslash before a plain char
    assert V.like_term("a\\") == "%a\\\\%"                 # trailing backslash is literal


def test_filters_combine(demo):
    rows = V.list_customers(demo, status="active", company_id=1, search="ali").collect()
    assert [r["first_name"] for r in rows] == ["Alice"]
    assert V.filter_customers(V.customer_360(demo), status="").count() == 6


def test_list_orders(demo, spark):
    assert [r["name"] for r in V.package_catalog(demo).collect()] == \
        ["Basic", "Professional", "Enterprise"]
    assert [r["name"] for r in V.promotion_catalog(demo).collect()] == \
        ["New Customer", "Summer Sale"]
    hist = V.list_subscriptions(demo, customer_id=6).collect()
    assert [r["id"] for r in hist] == [5]
    subs = [r["id"] for r in V.list_subscriptions(demo).collect()]
    assert subs == [1, 4, 2, 3, 5]                         # latest expiry first


def test_subscription_patch_cannot_move_customer(demo, spark):
    p = spark.createDataFrame([(1, True, 5, True, "cancelled")],
                              "id bigint, set_customer_id boolean, customer_id bigint, "
                              "set_status boolean, status string")
    new, out = CH.patch_batch(demo, p, "customer_packages", T)
    row = new.where("id = 1").first()
    assert row["customer_id"] == 1 and row["status"] == "cancelled"
    assert out.first()["outcome"] == "updated"


def test_zero_price_is_kept(demo, spark):
    zero = spark.createDataFrame(
        [(9, 4, 1, None, T, d(3), Decimal("0.00"), "active", T, T)], S.CUSTOMER_PACKAGES)
    t = overlay(demo, customer_packages=demo["customer_packages"].unionByName(zero))
    rows = {r["cp_id"]: r["price_paid"] for r in V.reminder_candidates(t, 7, T).collect()}
    assert rows[9] == "0.00"
    rec = {r["id"]: r["price_paid"] for r in V.expiring_within(t, 7, T).collect()}
    assert rec[9] == 0.0
