"""The write path as batch DataFrame jobs: inserts (W2), nested create
(W4), partial updates (W5), deletes with foreign-key propagation (W6),
assign-if-none (J6) and the fold of a change feed (W11's batch form).

Each write takes table DataFrames and a batch of requests and returns the
new table(s) plus one outcome row per request; nothing is mutated. The
caller writes the new tables as new versions (see ``sources.tables``).
"""

from __future__ import annotations

from collections import ChainMap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.time import at
from halyard.operators.ids import assign_ids, next_id
from halyard.operators.integrity import all_present
from halyard.operators.joins import is_small, present_in, small_side, spread_nulls
from halyard.operators.replay import any_field_set, apply_patches, judged_changes, last_set, patch_fields, writable_fields
from halyard.operators.validation import VALIDATORS, parse_utc_datetime
from halyard.session import pinned
from halyard.sources import schemas as S
from halyard.sources.fixtures import Tables

DATETIME_FIELDS = {"joined_at", "expires_at", "valid_from", "valid_until"}


# -- shared checks ------------------------------------------------------------------

def _parents(entity: str):
    return [(col, parent, rule) for child, col, parent, rule in S.FOREIGN_KEYS
            if child == entity]


def _flag_missing_parents(df: DataFrame, t, entity: str, cols: dict[str, Column],
                          small: bool | None = None, source: DataFrame | None = None) -> DataFrame:
    """Add an error code for each non-NULL foreign key without a parent.
    ``cols`` maps the FK column name to the request Column holding it;
    ``small`` is the broadcast bound of the batch, when known. The key sets
    are taken from ``source`` (the raw request batch), not from ``df``, so
    each check adds a small branch to the plan instead of copying it."""
    src = df if source is None else source
    out = df
    for col, parent, _rule in _parents(entity):
        if col not in cols or parent not in t:
            continue
        tag, pk = f"__has_{col}", f"__pk_{col}"
        found = present_in(src.select(cols[col].alias("__k")),
                           t[parent].select(F.col("id").alias("__k")), ["__k"], small)
        found = found.select(F.col("__k").alias(pk), F.lit(True).alias(tag))
        out = (out.join(found, cols[col] == F.col(pk), "left")
                  .withColumn("errors", F.when(
                      cols[col].isNotNull() & F.col(tag).isNull(),
                      F.array_append("errors", F.lit(f"{col}:no_parent")))
                      .otherwise(F.col("errors")))
                  .drop(tag, pk))
    return out


def _flag_unique(df: DataFrame, table: DataFrame, entity: str, order_by: str,
                 cols: dict[str, Column], small: bool | None = None,
                 source: DataFrame | None = None) -> DataFrame:
    """Add an error code for a unique key the table holds already (key set
    taken from ``source``), or that an earlier row of the batch (by
    ``order_by``) holds. Only rows passing every other check can take a key
    first; that minimum per key is a map-side combined aggregate joined back."""
    src = df if source is None else source
    out = df
    for keys in S.UNIQUE_KEYS.get(entity, []):
        if not all(k in cols for k in keys):
            continue
        names = [f"__u_{k}" for k in keys]
        asked = src.select(*[cols[k].alias(n) for k, n in zip(keys, names)])
        have = table.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        held = present_in(asked, have, names, small).withColumn("__held", F.lit(True))
        out = out.select("*", *[cols[k].alias(n) for k, n in zip(keys, names)])
        first = (out.where(all_present(names) & (F.size("errors") == 0))
                 .groupBy(*names).agg(F.min(order_by).alias("__first")))
        code = "unique:" + "+".join(keys)
        out = (out.join(held, names, "left").join(first, names, "left")
                  .withColumn("errors", F.when(
                      F.col("__held") | (F.col("__first") != F.col(order_by)),
                      F.array_append("errors", F.lit(code))).otherwise(F.col("errors")))
                  .drop("__held", "__first", *names))
    return out


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def _table_value(field: str, dtype, source: Column) -> Column:
    if field in DATETIME_FIELDS:
        return parse_utc_datetime(source).cast(dtype)
    return source.cast(dtype)


def to_table_rows(valid: DataFrame, entity: str, as_of, id_col: str = "id",
                  keep: list[str] | None = None) -> DataFrame:
    """Request rows to table rows: writable fields converted, absent ones
    defaulted (NULL or the column default), timestamps set to ``as_of``."""
    cols = []
    defaults = S.INSERT_DEFAULTS.get(entity, {})
    for f in S.TABLES[entity]:
        n = f.name
        if n == id_col:
            continue
        if n in ("created_at", "updated_at"):
            c = at(as_of).cast(f.dataType)
        elif entity == "customer_packages" and n == "status":
            c = F.lit("active")            # an insert always writes active
        elif entity == "customer_packages" and n == "joined_at":
            c = (F.coalesce(_table_value(n, f.dataType, F.col(n)), at(as_of))
                 if n in valid.columns else at(as_of))
        elif n in valid.columns:
            c = _table_value(n, f.dataType, F.col(n))
            if n in defaults:
                c = F.coalesce(c, F.lit(defaults[n]).cast(f.dataType))
        else:
            c = F.lit(defaults.get(n)).cast(f.dataType)
        cols.append(c.alias(n))
    carried = [c for c in valid.columns if c.startswith("row_") or c == "seq" or c in (keep or [])]
    return valid.select(*carried, *cols)


# -- W2 -----------------------------------------------------------------------------

def insert_batch(t, rows: DataFrame, entity: str, as_of, order_by: str = "row_id"):
    """Validate, check parents and unique keys, apply defaults and
    number the new rows after the last id issued (W3).
    Returns ``(inserted, rejected)``; ``rejected`` keeps ``errors``."""
    table = t[entity]
    small = is_small(rows)      # one count bounds every key set of the batch
    checked = VALIDATORS[entity](rows, checked_only=True).checked()
    cols = {c: F.col(c) for c in rows.columns}
    checked = _flag_missing_parents(checked, t, entity, cols, small, rows)
    checked = _flag_unique(checked, table, entity, order_by, cols, small, rows)
    valid, rejected = _split(pinned(checked, f"checked-{entity}"))
    new = to_table_rows(valid, entity, as_of)
    new = assign_ids(new, next_id(t, entity), [order_by])
    return new.select(order_by, *S.TABLES[entity].fieldNames()), rejected


# -- W4 -----------------------------------------------------------------------------

def create_with_subscription(t, rows: DataFrame, as_of, order_by: str = "row_id"):
    """Customers with an optional nested ``subscription`` struct,
    written together: a row whose customer or subscription fails any check
    writes neither. Returns ``(customers, subscriptions, rejected)``."""
    rows = pinned(rows, "create-requests")      # every check reads the batch
    small = is_small(rows)
    checked = VALIDATORS["customers"](rows, checked_only=True).checked()
    cust_cols = {c: F.col(c) for c in rows.columns if c != "subscription"}
    checked = _flag_missing_parents(checked, t, "customers", cust_cols, small, rows)
    sub = F.col("subscription")
    checked = _flag_missing_parents(checked, t, "customer_packages",
                                    {"package_id": sub["package_id"],
                                     "promotion_id": sub["promotion_id"]}, small, rows)
    checked = _flag_unique(checked, t["customers"], "customers", order_by, cust_cols, small,
                           rows)
    valid, rejected = _split(pinned(checked, "create-checked"))
    # One numbered batch of customers carries the nested subscription, and
    # the subscriptions are numbered from its written table, so both share
    # the customer ids.
    numbered = to_table_rows(valid, "customers", as_of, keep=["subscription"])
    numbered = assign_ids(numbered, next_id(t, "customers"), [order_by])
    customers = numbered.select(order_by, *S.CUSTOMERS.fieldNames())
    subs_req = numbered.where(sub.isNotNull()).select(
        order_by, F.col("id").alias("customer_id"),
        sub["package_id"].alias("package_id"), sub["promotion_id"].alias("promotion_id"),
        sub["joined_at"].alias("joined_at"), sub["expires_at"].alias("expires_at"),
        sub["price_paid"].alias("price_paid"))
    subs = to_table_rows(subs_req, "customer_packages", as_of)
    subs = assign_ids(subs, next_id(t, "customer_packages"), [order_by])
    subs = subs.select(order_by, *S.CUSTOMER_PACKAGES.fieldNames())
    return customers, subs, rejected


# -- fold (W5 / W11) ------------------------------------------------------------------

def fold_changes(changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Fold field-level changes to one row per key: for each field the
    latest set value by ``seq`` (an explicit NULL counts as set) and whether
    any patch set it; whether the key was deleted (a delete is final, so any
    patch of a deleted key finds no row), the sequence of its first delete,
    its last sequence and its numbers of patches and of rejected ones (op
    ``invalid``, see ``marked_changes``). All aggregates combine
    map-side, so a key with a third of all changes is one partial row per
    task; the same expression runs as a streaming aggregation (W11)."""
    fields = patch_fields(changes)
    is_patch = F.col("op") == "patch"
    is_delete = F.col("op") == "delete"
    aggs = []
    for f in fields:
        setf = is_patch & F.col(f"set_{f}")
        aggs.append(F.max_by(F.col(f), F.when(setf, F.col(seq))).alias(f))
        aggs.append(F.coalesce(F.bool_or(setf), F.lit(False)).alias(f"set_{f}"))
    aggs += [F.coalesce(F.bool_or(is_delete), F.lit(False)).alias("deleted"),
             F.min(F.when(is_delete, F.col(seq))).alias("delete_seq"),
             F.max(F.col(seq)).alias("last_seq"),
             F.count_if(is_patch).alias("patches"),
             F.count_if(F.col("op") == "invalid").alias("rejected")]
    return changes.groupBy(key).agg(*aggs)


# -- W5 -----------------------------------------------------------------------------

def marked_changes(changes: DataFrame, entity: str, t=None, small: bool | None = None) -> DataFrame:
    """``changes`` with the op of each patch that sets nothing or breaks a
    rule, or with tables ``t`` names a parent that does not exist, turned
    into ``invalid``. A projection (``t`` adds lookups), so it also runs on a
    stream."""
    fields = writable_fields(changes, entity)
    any_set = any_field_set(fields)
    checked = VALIDATORS[entity](changes, partial=True, checked_only=True).checked()
    if t is not None:
        checked = _flag_missing_parents(checked, t, entity, {
            f: F.when(F.col(f"set_{f}"), F.col(f)) for f in fields}, small, changes)
    bad = (F.col("op") == "patch") & ~(any_set & (F.size("errors") == 0))
    return checked.withColumn("op", F.when(bad, F.lit("invalid")).otherwise(F.col("op"))).drop("errors")


def patch_batch(t, patches: DataFrame, entity: str, as_of, small: bool | None = None):
    """Partial update. A field applies when ``set_<field>`` is true (an
    explicit NULL clears it); ``updated_at = as_of`` on changed rows. A
    patch that sets nothing or breaks a rule is rejected, an unknown id is
    not found. With a ``seq`` column the patches are applied in that order,
    each by itself (see ``replay.replay_changes``). Without ``seq`` they are
    taken in order of their ids, and, as there is no telling which is the
    last, all patches of an id that has several are rejected.
    Returns ``(new_table, outcomes)``, an outcome row for each patch: (seq,
    id, op, outcome, errors), without ``seq`` one for each id (id, outcome,
    errors)."""
    if "seq" in patches.columns:
        changes = patches if "op" not in patches.columns else patches.where(F.col("op") == "patch")
        judged = judged_changes(t, changes, entity, small)
        outcomes = judged.select("seq", "id", "op", "outcome", "errors")
    else:
        patches = pinned(patches, "patches")
        if small is None:
            small = is_small(patches)
        repeated = (patches.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("id"))
        once = patches.join(small_side(repeated, small=small), "id", "left_anti").withColumn("seq", F.col("id").cast("bigint"))
        judged = judged_changes(t, once, entity, small)
        outcomes = judged.select("id", "outcome", "errors").unionByName(
            repeated.select("id", F.lit("rejected").alias("outcome"), F.lit("repeated").alias("errors")))
    if small is None:
        small = is_small(judged)
    return apply_patches(t[entity], entity, last_set(judged, entity), as_of, small), outcomes


# -- W6 -----------------------------------------------------------------------------

def _memo(build):
    """``build`` called once; later calls return the same DataFrame."""
    box = []

    def get():
        if not box:
            box.append(build())
        return box[0]
    return get


def _cascade(builders: dict, base, parent: str, removed, small: bool | None = None) -> None:
    """Register how the removal of ``removed()`` (ids of ``parent``, column
    ``__gone``) reaches each child table: CASCADE removes rows (and recurses
    with them), SET NULL clears the reference. Each new table is a builder,
    so a table (and the row count behind its broadcast bound) is computed
    only if the caller reads it. ``small`` is the bound of ``removed`` when
    known; the rows a cascade removes in turn are counted when needed."""
    for child, col, p, rule in S.FOREIGN_KEYS:
        if p != parent or child not in base:
            continue
        prev = builders.get(child) or (lambda child=child: base[child])
        g_col = f"__g_{col}"

        def gone(removed=removed, g_col=g_col, small=small):
            return small_side(removed().select(F.col("__gone").alias(g_col)).distinct(),
                              small=small)
        if rule == "cascade":
            def kept(prev=prev, gone=gone, col=col, g_col=g_col):
                tbl, g = prev(), gone()
                return tbl.join(g, tbl[col] == g[g_col], "left_anti")

            def hit(prev=prev, gone=gone, col=col, g_col=g_col):
                tbl, g = prev(), gone()
                return (tbl.join(g, tbl[col] == g[g_col], "left_semi")
                        .select(F.col("id").alias("__gone")))
            builders[child] = _memo(kept)
            _cascade(builders, base, child, _memo(hit))
        elif rule == "set_null":
            def nulled(prev=prev, gone=gone, col=col, g_col=g_col):
                tbl = prev()
                g = gone().withColumn(f"__hit_{col}", F.lit(True))
                j = tbl.join(g, spread_nulls(tbl[col], tbl["id"]) == g[g_col], "left")
                return j.select([
                    F.when(F.col(f"__hit_{col}"), F.lit(None).cast(f.dataType))
                     .otherwise(F.col(f.name)).alias(f.name) if f.name == col
                    else F.col(f.name) for f in tbl.schema])
            builders[child] = _memo(nulled)


def delete_batch(t, entity: str, keys: DataFrame, key: str = "id", small: bool | None = None):
    """Delete rows of ``entity`` by id and propagate: CASCADE removes
    children (and their children), SET NULL clears the reference, RESTRICT
    refuses the delete of a parent still referenced. Everything is decided
    on the tables before the delete. Returns ``(new_tables, outcomes)``;
    each changed table is built when first read."""
    table = t[entity]
    req = keys.select(F.col(key).alias("__gone")).where(F.col("__gone").isNotNull()).distinct()
    if small is None:
        small = is_small(keys)      # bounds the keys, the deleted ids and their checks
    there = present_in(req, table.select(F.col("id").alias("__gone")), ["__gone"], small)
    found = req.join(there.withColumn("__tid", F.col("__gone")), "__gone", "left")
    blocked = None
    for child, col, parent, rule in S.FOREIGN_KEYS:
        if parent == entity and rule == "restrict" and child in t:
            part = present_in(req, t[child].select(F.col(col).alias("__gone")), ["__gone"],
                              small)
            blocked = part if blocked is None else blocked.unionByName(part)
    if blocked is not None:
        blocked = blocked.distinct().withColumn("__blocked", F.lit(True))
        found = found.join(blocked, "__gone", "left")
    else:
        found = found.withColumn("__blocked", F.lit(None).cast("boolean"))
    outcomes = found.select(
        F.col("__gone").alias("id"),
        F.when(F.col("__tid").isNull(), F.lit("not_found"))
         .when(F.col("__blocked"), F.lit("restricted")).otherwise(F.lit("deleted"))
         .alias("outcome"))
    removed = outcomes.where(F.col("outcome") == "deleted").select(F.col("id").alias("__gone"))
    builders = {entity: _memo(lambda: table.join(small_side(removed, small=small),
                                                 table["id"] == removed["__gone"], "left_anti"))}
    _cascade(builders, t, entity, lambda: removed, small)
    # New tables are built when read; later writes go to the first map.
    new = ChainMap({}, Tables(builders), t)
    return new, outcomes


def reached_rows(t, entity: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The ids of the rows in other tables that deleting ``gone`` (ids of
    ``entity``) removes or changes, by table; a table comes after those
    through which it is reached."""
    out: dict[str, DataFrame] = {}

    def walk(parent: str, ids: DataFrame) -> None:
        for child, col, p, rule in S.FOREIGN_KEYS:
            if p != parent or rule == "restrict" or child not in t:
                continue
            hit = t[child].join(ids.select(F.col("id").alias("__gone")),
                                F.col(col) == F.col("__gone"), "left_semi").select("id")
            before = out.pop(child, None)
            out[child] = hit if before is None else before.unionByName(hit)
            if rule == "cascade":
                walk(child, hit)
    walk(entity, gone)
    return out


def apply_folded(t, folded: DataFrame, entity: str, as_of):
    """W11's final step: deletes from the fold (W6), then the folded patches
    of the ids that were not deleted (W5); a restricted delete changes
    nothing, so the patches of its id apply. An id whose patches were all
    invalid is rejected. Returns ``(new_tables, outcomes)``."""
    small = is_small(folded)    # one count bounds the deletes and the patches
    dels = folded.where(F.col("deleted")).select("id")
    new, del_out = delete_batch(t, entity, dels, small=small)
    gone = del_out.where(F.col("outcome") != "restricted").select(F.col("id").alias("__gid"))
    patch = (folded.where(F.col("patches") > 0)
             .join(small_side(gone, small=small), F.col("id") == F.col("__gid"), "left_anti"))
    new_tbl, patch_out = patch_batch(new, patch.drop("deleted", "delete_seq", "last_seq",
                                                     "patches", "rejected"), entity, as_of, small=small)
    new[entity] = new_tbl
    refused = folded.where(~F.col("deleted") & (F.col("patches") == 0) & (F.col("rejected") > 0))
    return new, (del_out.unionByName(patch_out.select("id", "outcome"))
                 .unionByName(refused.select("id", F.lit("rejected").alias("outcome"))))


# -- J6 -----------------------------------------------------------------------------

def assign_if_none(t, requests: DataFrame, as_of, any_status: bool = False,
                   order_by: str = "seq"):
    """A subscription for each (customer e-mail, package name [,
    promotion name]) request unless the customer already has an active one
    (or any, with ``any_status``). Each name resolves to one id, the lowest
    of the rows holding it (J7's rule), so a request creates at most one
    subscription however many packages share a name; an unknown package or
    promotion name creates nothing. The first request of a customer in the
    batch wins. Requests carry ``joined_at``, ``expires_at`` (timestamps),
    ``price_paid`` and ``status``."""
    from halyard.operators.views import resolve_by_name
    requests = pinned(requests, "assign-requests")  # every lookup reads the batch
    small = is_small(requests)  # bounds every key set of the request batch
    emails = requests.select("customer_email")
    cust = t["customers"].select(F.col("id").alias("customer_id"),
                                 F.col("email").alias("customer_email"))
    if small:       # the customers found are measured, should an e-mail repeat
        cust = small_side(cust.join(F.broadcast(emails.distinct()), "customer_email", "left_semi"))
    req = requests.join(cust, "customer_email")
    req = resolve_by_name(req, t["packages"], "package_name", "package_id", small=small)
    req = resolve_by_name(req, t["promotions"], "promotion_name", "promotion_id", small=small)
    req = req.where(F.col("package_id").isNotNull()
                    & (F.col("promotion_name").isNull() | F.col("promotion_id").isNotNull()))
    cp = t["customer_packages"]
    holders = cp if any_status else cp.where(F.col("status") == "active")
    held = present_in(cust.select("customer_id"), holders.select("customer_id"),
                      ["customer_id"], small)
    req = req.join(held, "customer_id", "left_anti")
    first = req.groupBy("customer_id").agg(F.min(order_by).alias("__first"))
    req = req.join(first, "customer_id").where(F.col(order_by) == F.col("__first")).drop("__first")
    ts = at(as_of)
    rows = req.select(
        order_by, "customer_id", "package_id", "promotion_id", "joined_at", "expires_at",
        F.col("price_paid").cast("decimal(10,2)").alias("price_paid"), "status",
        ts.alias("created_at"), ts.alias("updated_at"))
    rows = assign_ids(rows, next_id(t, "customer_packages"), [order_by])
    return rows.select(order_by, *S.CUSTOMER_PACKAGES.fieldNames())
