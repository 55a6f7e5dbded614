"""Read views: catalogs, lookups, filtered lists, enriched joins.

``t`` is a dict of table DataFrames (see ``halyard.sources``). Every function
returns a lazy DataFrame; filters are written on the base columns so Catalyst
pushes them below the joins and into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.expressions import days_left, full_name, number_text
from halyard.functions.time import at_for, shift
from halyard.operators.joins import dimension_join, is_small, small_side, spread_nulls
from halyard.operators.records import company_record, customer_record, subscription_record

ACTIVE = "active"


# -- S2, S3, S4 ---------------------------------------------------------------

def package_catalog(t) -> DataFrame:
    """All packages, cheapest first."""
    return t["packages"].orderBy("price", "id")


def promotion_catalog(t) -> DataFrame:
    """S3: all promotions, latest ``valid_until`` first."""
    return t["promotions"].orderBy(F.desc("valid_until"), "id")


def lookup(view: DataFrame, keys: DataFrame, key_col: str = "id",
           view_key: str = "id") -> DataFrame:
    """Batch fetch by id. Every key row is kept, with the view's columns
    (NULL when absent) and ``found``."""
    v = view.withColumnRenamed(view_key, "__key")
    if is_small(keys):
        # Ids are unique: the rows found are no more than the keys asked for,
        # so the view is cut by the broadcast keys and, unless its rows are
        # wide, broadcast back.
        wanted = F.broadcast(keys.select(F.col(key_col).alias("__key")).distinct())
        v = small_side(v.join(wanted, "__key", "left_semi"), base=keys)
    else:
        v = small_side(v, base=view)
    out = keys.join(v, keys[key_col] == v["__key"], "left")
    return out.withColumn("found", F.col("__key").isNotNull()).drop("__key")


# -- J2, P5, F5-F7 --------------------------------------------------------------

def _named(t, table: str, name: str) -> DataFrame:
    return t[table].select("id", F.col("name").alias(name))


def subscription_enriched(t, subs: DataFrame | None = None) -> DataFrame:
    """Subscriptions INNER customers, INNER packages, LEFT promotions.
    Over the broadcast bound, packages and promotions that very many
    subscriptions hold are broadcast all the same (``dimension_join``)."""
    cp = t["customer_packages"] if subs is None else subs
    cust = t["customers"].select(F.col("id").alias("__cid"), "first_name", "last_name", "email")
    j = cp.join(cust, F.col("customer_id") == F.col("__cid")).drop("__cid")
    j = dimension_join(j, _named(t, "packages", "package_name"), "package_id", "inner", base=t["packages"])
    return dimension_join(j, _named(t, "promotions", "promotion_name"), "promotion_id", base=t["promotions"])


def list_subscriptions(t, customer_id=None, status: str | None = None,
                       customer_ids: DataFrame | None = None) -> DataFrame:
    """subscriptions of a customer (or of a batch of customers given
    as a DataFrame of ``id``) and/or with a status, latest expiry first."""
    cp = t["customer_packages"]
    if customer_id is not None:
        cp = cp.where(F.col("customer_id") == F.lit(customer_id))
    if customer_ids is not None:
        keys = customer_ids.select(F.col("id").alias("__cid"))
        cp = cp.join(keys, cp["customer_id"] == keys["__cid"], "left_semi")
    if status:
        cp = cp.where(F.col("status") == F.lit(status))
    return (subscription_record(subscription_enriched(t, cp))
            .orderBy(F.desc("expires_at"), "id"))


def expiring_predicate(cp: DataFrame, days, as_of):
    """Active and ``as_of <= expires_at <= as_of + days`` (both ends in).
    The bounds are constants, so the predicate reaches the parquet scan."""
    lo = at_for(cp, "expires_at", as_of)
    hi = at_for(cp, "expires_at", shift(as_of, days))
    return (F.col("status") == ACTIVE) & F.col("expires_at").between(lo, hi)


def expiring_within(t, days=7, as_of=None) -> DataFrame:
    """active subscriptions expiring within ``days``, earliest first."""
    cp = t["customer_packages"]
    cp = cp.where(expiring_predicate(cp, days, as_of))
    return subscription_record(subscription_enriched(t, cp)).orderBy("expires_at", "id")


# -- F8, F9 ---------------------------------------------------------------------

def package_options(t) -> DataFrame:
    """F8: active packages labelled ``name ($price / Nd)``."""
    p = t["packages"].where(F.col("active"))
    label = F.concat(F.col("name"), F.lit(" ($"), number_text("price"), F.lit(" / "),
                     F.col("duration_days").cast("string"), F.lit("d)"))
    return p.select("id", label.alias("label"))


def promotion_options(t) -> DataFrame:
    """active promotions (validity dates not checked) labelled
    ``name (P%) ($A off)``, each part only when present."""
    p = t["promotions"].where(F.col("active"))
    pct = F.when(F.col("discount_percent").isNotNull(),
                 F.concat(F.lit(" ("), number_text("discount_percent"), F.lit("%)")))
    amt = F.when(F.col("discount_amount").isNotNull(),
                 F.concat(F.lit(" ($"), number_text("discount_amount"), F.lit(" off)")))
    label = F.concat(F.col("name"), F.coalesce(pct, F.lit("")), F.coalesce(amt, F.lit("")))
    return p.select("id", label.alias("label"))


# -- J1, A12 ----------------------------------------------------------------------

def customer_counts(t) -> DataFrame:
    """Customers per company id (partial aggregation before the shuffle)."""
    return (t["customers"].where(F.col("company_id").isNotNull())
            .groupBy("company_id").agg(F.count(F.lit(1)).alias("customer_count")))


def companies_with_counts(t) -> DataFrame:
    counts = customer_counts(t)
    comp = t["companies"]
    return (comp.join(counts, comp["id"] == counts["company_id"], "left")
            .drop("company_id"))


def collated(name: str | Column, collation: str | None) -> Column:
    """``name`` compared by a Spark collation (e.g. ``en``: letters before
    their capitals and accents by language; ``UNICODE_CI``, ``UNICODE_CI_AI``: also
    regardless of case, or of both); by its bytes without one."""
    c = F.col(name) if isinstance(name, str) else name
    return F.collate(c, collation) if collation else c


def company_list(t, collation: str | None = None) -> DataFrame:
    """Companies with their customer count (0 when none), by name: in
    binary order, or in that of ``collation``; equal names by id."""
    return company_record(companies_with_counts(t)).orderBy(collated("name", collation), "id")


# -- J3, J4, F1-F4 -----------------------------------------------------------------

def current_subscription(t) -> DataFrame:
    """Each customer's active subscription with the latest expiry (ties:
    higher id). Catalyst adds a partial per-key limit before the shuffle, so a
    customer with a huge history costs one row per map task."""
    w = Window.partitionBy("customer_id").orderBy(F.desc("expires_at"), F.desc("id"))
    return (t["customer_packages"].where(F.col("status") == ACTIVE)
            .withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn"))


def customer_360(t) -> DataFrame:
    """Customers LEFT companies, LEFT current subscription, LEFT package,
    LEFT promotion."""
    c = t["customers"]
    cur = current_subscription(t).select(
        F.col("customer_id").alias("__cust"), F.col("id").alias("cp_id"), "package_id",
        "joined_at", "expires_at", "price_paid", F.col("status").alias("cp_status"),
        "promotion_id")
    j = dimension_join(c, _named(t, "companies", "company_name"), "company_id", base=t["companies"])
    j = j.join(cur, F.col("id") == F.col("__cust"), "left").drop("__cust")
    j = dimension_join(j, _named(t, "packages", "package_name"), "package_id", base=t["packages"])
    return dimension_join(j, _named(t, "promotions", "promotion_name"), "promotion_id", base=t["promotions"])


def like_term(term: str) -> str:
    """``%term%`` for ILIKE with PostgreSQL escapes: ``\\%``, ``\\_`` and
    ``\\\\`` stay escapes, a backslash before any other character is dropped
    (it escapes a plain character), a trailing one is literal. ``%`` and
    ``_`` in the term stay wildcards."""
    out, i = [], 0
    while i < len(term):
        ch = term[i]
        if ch == "\\":
            nxt = term[i + 1] if i + 1 < len(term) else None
            if nxt is None:
                out.append("\\\\")
            elif nxt in "%_\\":
                out.append("\\" + nxt)
            else:
                out.append(nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def filter_customers(view: DataFrame, status: str | None = None, company_id=None,
                     search: str | None = None) -> DataFrame:
    """Status equality, company equality, case-insensitive substring
    on first name, last name or email. Absent or empty means no filter."""
    if status:
        view = view.where(F.col("status") == F.lit(status))
    if company_id is not None and company_id != "":
        view = view.where(F.col("company_id") == F.lit(int(company_id)))
    if search:
        pat = like_term(search)
        view = view.where(F.col("first_name").ilike(pat) | F.col("last_name").ilike(pat)
                          | F.col("email").ilike(pat))
    return view


def list_customers(t, status=None, company_id=None, search=None) -> DataFrame:
    """the filtered customer list, newest first."""
    view = filter_customers(customer_360(t), status, company_id, search)
    return customer_record(view).orderBy(F.desc("created_at"), "id")


# -- J5 -----------------------------------------------------------------------------

def reminder_candidates(t, days=7, as_of=None, subs: DataFrame | None = None) -> DataFrame:
    """``reminder_rows``, earliest expiry first."""
    return reminder_rows(t, days, as_of, subs).orderBy("expires_at", "cp_id")


def reminder_rows(t, days=7, as_of=None, subs: DataFrame | None = None) -> DataFrame:
    """Active subscriptions expiring within the horizon with customer name,
    email, package, whole days left and the price as text, in no order."""
    cp = t["customer_packages"] if subs is None else subs
    cp = cp.where(expiring_predicate(cp, days, as_of))
    cust = t["customers"].select(F.col("id").alias("__cid"), "first_name", "last_name", "email")
    j = cp.join(cust, F.col("customer_id") == F.col("__cid")).drop("__cid")
    j = dimension_join(j, _named(t, "packages", "package_name"), "package_id", "inner", base=t["packages"])
    dtype = cp.schema["expires_at"].dataType
    return j.select(
        F.col("id").alias("cp_id"), full_name("first_name", "last_name").alias("customer_name"),
        "email", "package_name", "joined_at", "expires_at",
        days_left("expires_at", as_of, dtype).cast("int").alias("days_left"),
        F.col("price_paid").cast("string").alias("price_paid"),
    )


# -- J7 -----------------------------------------------------------------------------

def resolve_by_name(df: DataFrame, dim: DataFrame, name_col: str,
                    out_col: str = "resolved_id", dim_name: str = "name",
                    small: bool | None = None, collation: str | None = None) -> DataFrame:
    """The id of the dimension row with that name; NULL when absent, the
    lowest id when several share the name. With ``small`` (the batch is
    under the broadcast bound) the dimension is first cut to the requested
    names by a semi join against the broadcast names, so a large dimension
    is read once and never shuffled. With ``collation`` names that it holds
    equal are one name."""
    if collation:
        key = "__collated"
        out = resolve_by_name(df.withColumn(key, collated(name_col, collation)),
                              dim.select("id", collated(dim_name, collation).alias(key)), key, out_col, key, small)
        return out.drop(key)
    if small:
        names = F.broadcast(df.select(F.col(name_col).alias(dim_name)).distinct())
        ids = (dim.join(names, dim_name, "left_semi")
               .groupBy(F.col(dim_name).alias("__name")).agg(F.min("id").alias(out_col)))
        ids = F.broadcast(ids)
    else:
        ids = dim.groupBy(F.col(dim_name).alias("__name")).agg(F.min("id").alias(out_col))
        ids = small_side(ids, base=dim)
    return df.join(ids, df[name_col] == ids["__name"], "left").drop("__name")


# -- E15 ----------------------------------------------------------------------------

def default_terms(requests: DataFrame, packages: DataFrame, as_of,
                  key: str = "row_id", package_col: str = "package_id") -> DataFrame:
    """For each (request, package) the form's defaults: expiry at
    midnight UTC of as_of's date plus the package duration (30 days when
    unknown) and the package's list price."""
    from halyard.functions.expressions import default_expiry
    pk = small_side(packages.select(F.col("id").alias("__pid"), "duration_days", "price"),
                    packages)
    j = requests.join(pk, requests[package_col] == pk["__pid"], "left")
    return j.select(key, package_col,
                    default_expiry("duration_days", as_of).alias("default_expires_at"),
                    F.col("price").cast("double").alias("default_price"))
