"""Registered write-path jobs (W1-W11) and validators (V1-V5)."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.time import at
from halyard.operators import changes as CH
from halyard.operators import integrity as I
from halyard.operators import lifecycle as L
from halyard.operators import maintained as MC
from halyard.operators import metrics as M
from halyard.operators import validation as VAL
from halyard.operators import views as V
from halyard.operators.ids import assign_ids
from halyard.operators.replay import replay_changes
from halyard.plans.catalog import AS_OF, register
from halyard.plans.catalog_metrics import METRIC_SQL
from halyard.plans.catalog_reads import CANDIDATES
from halyard.session import pinned, scratch_dir
from halyard.sources import requests as RQ
from halyard.sources import schemas as S
from halyard.sources.fixtures import overlay
from halyard.sources.tables import latest_version
from halyard.streaming.change_stream import apply_change_stream, replay_change_stream


def is_email_sql(x: str) -> str:
    """The e-mail rule by its grammar: words between dots, an @, labels."""
    name, domain = f"string_split({x}, '@')[1]", f"string_split({x}, '@')[2]"
    return (f"(len(string_split({x}, '@')) = 2 AND NOT ends_with({name}, '''') "
            f"AND regexp_full_match({name}, '[A-Za-z0-9_''+-]+([.][A-Za-z0-9_''+-]+)*') "
            f"AND regexp_full_match({domain}, '([A-Za-z0-9][A-Za-z0-9-]*[.])+[A-Za-z]{{2,}}'))")


def is_dt_sql(x: str) -> str:
    """The date-time rule by parsing what stands before the fraction."""
    return (f"(regexp_full_match({x}, '.{{10}}T.{{8}}([.][0-9]+)?Z') "
            f"AND regexp_full_match(left({x}, 10), '[0-9]+-[0-9]{{2}}-[0-9]{{2}}') "
            f"AND try_strptime(left({x}, 19), '%Y-%m-%dT%H:%M:%S') IS NOT NULL)")


def parse_dt_sql(x: str) -> str:
    return f"CAST(replace(replace({x}, 'T', ' '), 'Z', '') AS TIMESTAMP)"


def text_rules(f: str, lo=None, hi=None, required=False, email=False, dt=False) -> list[str]:
    out = []
    if required:
        out.append(f"CASE WHEN {f} IS NULL THEN '{f}:required' END")
    if lo is not None:
        out.append(f"CASE WHEN length({f}) < {lo} THEN '{f}:too_short' END")
    if hi is not None:
        out.append(f"CASE WHEN length({f}) > {hi} THEN '{f}:too_long' END")
    if email:
        out.append(f"CASE WHEN {f} IS NOT NULL AND NOT {is_email_sql(f)} THEN '{f}:email' END")
    if dt:
        out.append(f"CASE WHEN {f} IS NOT NULL AND NOT {is_dt_sql(f)} THEN '{f}:datetime' END")
    return out


def num_rules(f: str, lo=None, hi=None, integer=False, required=False) -> list[str]:
    out = []
    if required:
        out.append(f"CASE WHEN {f} IS NULL THEN '{f}:required' END")
    if integer:
        out.append(f"CASE WHEN CAST({f} AS DOUBLE) <> floor(CAST({f} AS DOUBLE)) "
                   f"THEN '{f}:integer' END")
    if lo is not None:
        out.append(f"CASE WHEN {f} < {lo} THEN '{f}:too_small' END")
    if hi is not None:
        out.append(f"CASE WHEN {f} > {hi} THEN '{f}:too_big' END")
    return out


def enum_rule(f: str, values: list[str]) -> list[str]:
    vals = ", ".join(f"'{v}'" for v in values)
    return [f"CASE WHEN {f} IS NOT NULL AND {f} NOT IN ({vals}) THEN '{f}:enum' END"]


def report_sql(view: str, rules: list[str]) -> str:
    errs = "concat_ws('|', " + ", ".join(rules) + ")"
    return (f"SELECT row_id, {errs} = '' AS valid, {errs} AS errors FROM {view}")


V1_RULES = (text_rules("name", 1, 200, required=True) + text_rules("email", hi=200, email=True)
            + text_rules("phone", hi=50) + text_rules("address", hi=1000))
V2_RULES = (text_rules("name", 1, 100, required=True) + text_rules("description", hi=2000)
            + num_rules("price", lo=0, required=True)
            + num_rules("duration_days", lo=1, integer=True, required=True))
V3_RULES = (text_rules("name", 1, 200, required=True) + text_rules("description", hi=2000)
            + num_rules("discount_percent", lo=0, hi=100) + num_rules("discount_amount", lo=0)
            + text_rules("valid_from", required=True, dt=True)
            + text_rules("valid_until", required=True, dt=True))
V4_RULES = (text_rules("first_name", 1, 100, required=True)
            + text_rules("last_name", 1, 100, required=True)
            + text_rules("email", hi=200, required=True, email=True)
            + text_rules("phone", hi=50) + enum_rule("status", VAL.CUSTOMER_STATUSES))
V5_RULES = (num_rules("customer_id", integer=True, required=True)
            + num_rules("package_id", integer=True, required=True)
            + text_rules("expires_at", required=True, dt=True) + num_rules("price_paid", lo=0)
            + enum_rule("status", VAL.SUBSCRIPTION_STATUSES))


def json_error_sql(path: str, code: str, types: str, kind: str, nullable: bool) -> str:
    """The error code of one JSON field by DuckDB's own JSON types."""
    t = f"json_type(body, '{path}')"
    null = "" if nullable else f"WHEN {t} = 'NULL' THEN '{code}:required' "
    value = f"TRY_CAST(json_extract_string(body, '{path}') AS DOUBLE)"
    whole = f" AND {value} = floor({value})" if kind == "integer" else ""
    return f"CASE {null}WHEN {t} IS NOT NULL AND {t} <> 'NULL' AND NOT ({t} IN ({types}){whole}) THEN '{code}:{kind}' END"


def json_errors_sql(fields: list[tuple], path: str = "$.", code: str = "") -> list[str]:
    kinds = {"text": ("'VARCHAR'", "string"), "number": ("'UBIGINT', 'BIGINT', 'DOUBLE'", "number"),
             "whole": ("'UBIGINT', 'BIGINT', 'DOUBLE'", "integer"), "flag": ("'BOOLEAN'", "boolean")}
    return [json_error_sql(path + n, code + c, *kinds[k], nullable) for n, c, k, nullable in fields]


def _said(path: str, of: str, rules: list[str]) -> list[str]:
    """Rules on a field that has the right JSON type, or is absent."""
    value = f"json_extract_string(body, '{path}')"
    return [f"CASE WHEN NOT list_contains(bad, '{of}') THEN {r.replace('{x}', value)} END" for r in rules]


_NESTED = "json_type(body, '$.packageAssignment') = 'OBJECT'"
_GIVEN = json_errors_sql(RQ.FIELDS["customers"]) + [
    "CASE WHEN json_type(body, '$.packageAssignment') NOT IN ('OBJECT', 'NULL') THEN 'subscription:object' END"] + [
    f"CASE WHEN {_NESTED} THEN {e} END" for e in json_errors_sql(RQ.NESTED_FIELDS, "$.packageAssignment.", "subscription.")]
_CASE = f"CASE WHEN {_NESTED} AND "
_RULES = (
    [r for n, c in (("firstName", "first_name"), ("lastName", "last_name")) for r in _said(f"$.{n}", c, [
        f"CASE WHEN {{x}} IS NULL THEN '{c}:required' END", f"CASE WHEN length({{x}}) < 1 THEN '{c}:too_short' END",
        f"CASE WHEN length({{x}}) > 100 THEN '{c}:too_long' END"])]
    + _said("$.email", "email", [
        "CASE WHEN {x} IS NULL THEN 'email:required' END", "CASE WHEN length({x}) > 200 THEN 'email:too_long' END",
        "CASE WHEN {x} IS NOT NULL AND NOT " + is_email_sql("{x}") + " THEN 'email:email' END"])
    + _said("$.phone", "phone", ["CASE WHEN length({x}) > 50 THEN 'phone:too_long' END"])
    + _said("$.status", "status", ["CASE WHEN {x} NOT IN ('active', 'inactive', 'churned') THEN 'status:enum' END"])
    + _said("$.notes", "notes", ["CASE WHEN length({x}) > 2000 THEN 'notes:too_long' END"])
    + _said("$.packageAssignment.packageId", "subscription.package_id", [_CASE + "{x} IS NULL THEN 'subscription.package_id:required' END"])
    + _said("$.packageAssignment.joinedAt", "subscription.joined_at", [
        _CASE + "{x} IS NOT NULL AND NOT " + is_dt_sql("{x}") + " THEN 'subscription.joined_at:datetime' END"])
    + _said("$.packageAssignment.expiresAt", "subscription.expires_at", [
        _CASE + "{x} IS NULL THEN 'subscription.expires_at:required' END",
        _CASE + "{x} IS NOT NULL AND NOT " + is_dt_sql("{x}") + " THEN 'subscription.expires_at:datetime' END"])
    + _said("$.packageAssignment.pricePaid", "subscription.price_paid", [
        _CASE + "CAST({x} AS DOUBLE) < 0 THEN 'subscription.price_paid:too_small' END"]))


@register("json_requests", """
WITH filled AS (SELECT row_id, CASE WHEN trim(body) = '' THEN '{}' ELSE body END AS body FROM json_customers),
ok AS (SELECT row_id, body FROM filled WHERE CASE WHEN json_valid(body) THEN json_type(body) END = 'OBJECT'),
given AS (SELECT row_id, body, list_filter([""" + ", ".join(_GIVEN) + """], lambda e: e IS NOT NULL) AS g FROM ok),
named AS (SELECT *, list_transform(g, lambda e: split_part(e, ':', 1)) AS bad FROM given),
told AS (SELECT row_id, g || list_filter([""" + ", ".join(_RULES) + """], lambda e: e IS NOT NULL) AS e FROM named)
SELECT row_id, len(e) = 0 AS valid, array_to_string(e, '|') AS errors FROM told
UNION ALL SELECT row_id, FALSE, 'body:json' FROM filled WHERE row_id NOT IN (SELECT row_id FROM ok)""")
def _json_requests(t):
    """V4 over customer requests as JSON text: absent and null told apart,
    wrong types and broken bodies kept with their codes."""
    return VAL.validation_report(RQ.parse_requests(t["json_customers"], "customers"), "customers")


@register("json_patch_outcomes", """
WITH p AS (SELECT j.*, c.id IS NOT NULL AS found FROM json_patches j LEFT JOIN customers c ON c.id = j.id),
told AS (
  SELECT seq, id, found, CASE
    WHEN body IN ('oops', '{"notes": "a", "notes') THEN 'body:json' WHEN body = '{}' THEN 'no_fields'
    WHEN body = '{"phone": 5}' THEN 'phone:string' WHEN contains(body, '"status": null') THEN 'status:required' ELSE '' END AS broken,
    CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.companyId') AS BIGINT) END AS company_id FROM p)
SELECT seq, id, 'patch' AS op,
       CASE WHEN broken <> '' THEN 'rejected' WHEN NOT found THEN 'not_found'
            WHEN company_id NOT IN (SELECT id FROM companies) THEN 'rejected' ELSE 'updated' END AS outcome,
       CASE WHEN broken = '' AND company_id NOT IN (SELECT id FROM companies) THEN 'company_id:no_parent' ELSE broken END AS errors
FROM told""")
def _json_patch_outcomes(t):
    """W5 over patches as JSON text: the outcome of each."""
    patches = RQ.parse_requests(t["json_patches"], "customers", partial=True)
    return CH.patch_batch(t, patches, "customers", AS_OF)[1]


@register("validate_companies", report_sql("dirty_companies", V1_RULES))
def _v1(t):
    """V1 over the dirty company requests."""
    return VAL.validation_report(t["dirty_companies"], "companies")


@register("validate_packages", report_sql("dirty_packages", V2_RULES))
def _v2(t):
    """V2 over the dirty package requests."""
    return VAL.validation_report(t["dirty_packages"], "packages")


@register("validate_promotions", report_sql("dirty_promotions", V3_RULES))
def _v3(t):
    """V3 over the dirty promotion requests."""
    return VAL.validation_report(t["dirty_promotions"], "promotions")


@register("validate_customers", report_sql("dirty_customers", V4_RULES))
def _v4(t):
    """V4 over the dirty customer requests."""
    return VAL.validation_report(t["dirty_customers"], "customers")


@register("validate_subscriptions", report_sql("dirty_subscriptions", V5_RULES))
def _v5(t):
    """V5 over the dirty subscription requests."""
    return VAL.validation_report(t["dirty_subscriptions"], "customer_packages")


# -- W1, W3 ------------------------------------------------------------------------------

STALE = "status = 'active' AND expires_at < {AS_OF}"


@register("auto_expire", f"""
SELECT id, customer_id, package_id, promotion_id, joined_at, expires_at,
       CAST(price_paid AS DOUBLE) AS price_paid,
       CASE WHEN {STALE} THEN 'expired' ELSE status END AS status, created_at,
       CASE WHEN {STALE} THEN {{AS_OF}} ELSE updated_at END AS updated_at
FROM customer_packages""")
def _auto_expire(t):
    """The subscriptions after past-due active rows expire."""
    return L.auto_expire(t["customer_packages"], AS_OF)


@register("surrogate_ids", """
SELECT id, row_number() OVER (ORDER BY expires_at, id) AS seq_id FROM customer_packages""")
def _surrogate_ids(t):
    """Dense ids for all subscriptions in expiry order, the partitioned
    way (as for a table of any size): no global window over the rows."""
    cp = t["customer_packages"].select("id", "expires_at")
    n = int(cp.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return assign_ids(cp, 0, ["expires_at", "id"], id_col="seq_id", partitions=n) \
        .select("id", "seq_id")


# -- W2 ------------------------------------------------------------------------------------

_INSERT_ERRORS = "concat_ws('|', " + ", ".join(V5_RULES) + """,
    CASE WHEN customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM customers) THEN 'customer_id:no_parent' END,
    CASE WHEN package_id IS NOT NULL AND package_id NOT IN (SELECT id FROM packages) THEN 'package_id:no_parent' END)"""


@register("insert_batch", """
WITH told AS (SELECT *, """ + _INSERT_ERRORS + """ AS errors FROM dirty_subscriptions),
ok AS (SELECT * FROM told WHERE errors = '')
SELECT row_id, (SELECT max(id) FROM customer_packages) + row_number() OVER (ORDER BY row_id) AS id,
       customer_id, package_id, CAST(NULL AS BIGINT) AS promotion_id, {AS_OF} AS joined_at,
       """ + parse_dt_sql("expires_at") + """ AS expires_at,
       CAST(CAST(price_paid AS DECIMAL(10,2)) AS DOUBLE) AS price_paid, 'active' AS status,
       {AS_OF} AS created_at, {AS_OF} AS updated_at, errors
FROM ok
UNION ALL
SELECT row_id, NULL, customer_id, package_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, errors FROM told WHERE errors <> ''""")
def _insert_batch(t):
    """The valid subscription requests inserted with defaults and ids, and
    the rejected ones with their error codes."""
    inserted, rejected = CH.insert_batch(t, t["dirty_subscriptions"], "customer_packages", AS_OF)
    kept = rejected.select("row_id", "customer_id", "package_id", F.concat_ws("|", "errors").alias("errors"))
    return inserted.withColumn("errors", F.lit("")).unionByName(kept, allowMissingColumns=True)


# -- W4 ------------------------------------------------------------------------------------

@register("create_with_subscription", """
WITH chk AS (
  SELECT r.*,
    length(first_name) BETWEEN 1 AND 100 AND length(last_name) BETWEEN 1 AND 100
    AND length(email) <= 200 AND """ + is_email_sql("email") + """
    AND (company_id IS NULL OR EXISTS (SELECT 1 FROM companies co WHERE co.id = r.company_id))
    AND (NOT has_subscription OR (
          sub_expires_at IS NOT NULL AND """ + is_dt_sql("sub_expires_at") + """
          AND (sub_price_paid IS NULL OR sub_price_paid >= 0)
          AND EXISTS (SELECT 1 FROM packages p WHERE p.id = r.sub_package_id)
          AND (sub_promotion_id IS NULL
               OR EXISTS (SELECT 1 FROM promotions pr WHERE pr.id = r.sub_promotion_id))))
    AS ok_other
  FROM customer_requests r),
firsts AS (SELECT email, min(row_id) AS first_id FROM chk WHERE ok_other GROUP BY email),
ok AS (SELECT chk.* FROM chk JOIN firsts ON firsts.email = chk.email AND firsts.first_id = chk.row_id
       WHERE NOT EXISTS (SELECT 1 FROM customers c WHERE c.email = chk.email)),
cust AS (SELECT ok.*, (SELECT max(id) FROM customers) + row_number() OVER (ORDER BY row_id) AS id
         FROM ok),
subs AS (SELECT row_id, (SELECT max(id) FROM customer_packages)
                        + row_number() OVER (ORDER BY row_id) AS cp_id
         FROM ok WHERE has_subscription)
SELECT cust.row_id, cust.id, cust.email, cust.company_id, subs.cp_id,
       CASE WHEN has_subscription THEN sub_package_id END AS package_id,
       CASE WHEN has_subscription THEN """ + parse_dt_sql("sub_expires_at") + """ END AS expires_at
FROM cust LEFT JOIN subs ON subs.row_id = cust.row_id""")
def _create_with_subscription(t):
    """New customers and their nested subscriptions, both or neither."""
    cust, subs, _rej = CH.create_with_subscription(t, t["customer_requests"], AS_OF)
    s = subs.select("row_id", F.col("id").alias("cp_id"), "package_id", "expires_at")
    return cust.select("row_id", "id", "email", "company_id").join(s, "row_id", "left")


# -- W5, W11 ----------------------------------------------------------------------------------

def _patched_customers_sql(with_deletes: bool) -> str:
    dels = ("\nWHERE c.id NOT IN (SELECT id FROM customer_changes WHERE op = 'delete')"
            if with_deletes else "")
    return """
WITH ch AS (SELECT * FROM customer_changes WHERE op = 'patch'
            AND (NOT set_status OR status IN ('active', 'inactive', 'churned'))),
ls AS (SELECT id, max(seq) AS s FROM ch WHERE set_status GROUP BY id),
st AS (SELECT ch.id, ch.status FROM ch JOIN ls ON ls.id = ch.id AND ls.s = ch.seq),
lnn AS (SELECT id, max(seq) AS s FROM ch WHERE set_notes GROUP BY id),
nt AS (SELECT ch.id, ch.notes FROM ch JOIN lnn ON lnn.id = ch.id AND lnn.s = ch.seq),
touched AS (SELECT DISTINCT id FROM ch)
SELECT c.id, c.first_name, c.last_name, c.email, c.phone, c.company_id,
       CASE WHEN st.id IS NOT NULL THEN st.status ELSE c.status END AS status,
       CASE WHEN nt.id IS NOT NULL THEN nt.notes ELSE c.notes END AS notes,
       c.created_at,
       CASE WHEN touched.id IS NOT NULL THEN {AS_OF} ELSE c.updated_at END AS updated_at
FROM customers c LEFT JOIN st ON st.id = c.id LEFT JOIN nt ON nt.id = c.id
LEFT JOIN touched ON touched.id = c.id""" + dels


@register("patch_batch", _patched_customers_sql(False))
def _patch_batch(t):
    """Customers after the folded patches of the change feed."""
    new, _outcomes = CH.patch_batch(t, t["customer_changes"], "customers", AS_OF)
    return new


# One change after the other: a map from each customer concerned to its
# address, rewritten by every edit that asks for an address or deletes.
REPLAY_SQL = """
WITH RECURSIVE known AS (
  SELECT e.*, c.id IS NOT NULL AND (d.seq IS NULL OR e.seq <= d.seq) AS found,
         CASE WHEN e.email = 'no address' THEN 'email:email' ELSE '' END AS broken
  FROM customer_edits e LEFT JOIN customers c ON c.id = e.id
  LEFT JOIN (SELECT id, min(seq) AS seq FROM customer_edits WHERE op = 'delete' GROUP BY id) d ON d.id = e.id),
steps AS (
  SELECT row_number() OVER (ORDER BY seq) AS n, seq, id, op, email FROM known
  WHERE found AND broken = '' AND (op = 'delete' OR email IS NOT NULL)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, TRUE AS stands,
         (SELECT map_from_entries(list((id, email))) FROM customers
          WHERE id IN (SELECT id FROM steps) OR email IN (SELECT email FROM steps)) AS mails
  UNION ALL
  SELECT n, seq, stands, CASE WHEN stands THEN map_concat(mails, MAP {id: email}) ELSE mails END
  FROM (SELECT s.n, s.seq, s.id, s.email, w.mails, s.op = 'delete' OR coalesce(w.mails[s.id] = s.email, FALSE)
               OR NOT list_contains(map_values(w.mails), s.email) AS stands
        FROM walk w JOIN steps s ON s.n = w.n + 1)),
told AS (
  SELECT k.*, CASE WHEN broken <> '' THEN 'rejected' WHEN email IS NULL AND set_email THEN 'rejected'
                   WHEN NOT found THEN 'not_found' WHEN op = 'delete' THEN 'deleted'
                   WHEN NOT coalesce(w.stands, TRUE) THEN 'rejected' ELSE 'updated' END AS outcome,
         CASE WHEN broken <> '' THEN broken WHEN email IS NULL AND set_email THEN 'email:required'
              WHEN found AND NOT coalesce(w.stands, TRUE) THEN 'unique:email' ELSE '' END AS errors
  FROM known k LEFT JOIN walk w ON w.seq = k.seq)"""


@register("change_outcomes", REPLAY_SQL + "\nSELECT seq, id, op, outcome, errors FROM told")
def _change_outcomes(t):
    """The outcome of each of the customers' edits, applied one
    after the other; addresses are freed, swapped and contested."""
    _new, outcomes = replay_changes(t, t["customer_edits"], "customers", AS_OF)
    return outcomes


@register("change_replay", REPLAY_SQL + """,
lasts AS (
  SELECT id, arg_max(struct_pack(v := email), seq) FILTER (WHERE set_email) AS email,
         arg_max(struct_pack(v := status), seq) FILTER (WHERE set_status) AS status,
         arg_max(struct_pack(v := notes), seq) FILTER (WHERE set_notes) AS notes
  FROM told WHERE outcome = 'updated' GROUP BY id)
SELECT c.id, c.first_name, c.last_name, CASE WHEN l.email IS NULL THEN c.email ELSE l.email.v END AS email, c.phone, c.company_id,
       CASE WHEN l.status IS NULL THEN c.status ELSE l.status.v END AS status,
       CASE WHEN l.notes IS NULL THEN c.notes ELSE l.notes.v END AS notes, c.created_at,
       CASE WHEN l.id IS NULL THEN c.updated_at ELSE {AS_OF} END AS updated_at
FROM customers c LEFT JOIN lasts l ON l.id = c.id
WHERE c.id NOT IN (SELECT id FROM told WHERE outcome = 'deleted')""")
def _change_replay(t):
    """The customers after all edits, applied one after the other."""
    new, _outcomes = replay_changes(t, t["customer_edits"], "customers", AS_OF)
    return new["customers"]


@register("change_replay_stream", REPLAY_SQL + "\nSELECT seq, id, op, outcome, errors FROM told")
def _change_replay_stream(t):
    """The edits read as a stream and applied one after the other, each
    micro-batch published as one commit; the outcomes, read back."""
    stream = t["customer_edits_stream"]
    spark = stream.sparkSession
    target = scratch_dir(spark, "w11-edits")
    query = replay_change_stream(stream, t, target, scratch_dir(spark, "w11-edits-state"), AS_OF)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{target}/customers_outcomes")


@register("change_stream", _patched_customers_sql(True))
def _change_stream(t):
    """The change feed read as a stream, folded by a stateful
    aggregation and applied to customers micro-batch by micro-batch
    (foreachBatch, versioned writes under the checkpoint folder); the final
    version, read back. A delete is final."""
    stream = t["customer_changes_stream"]
    spark = stream.sparkSession
    target = scratch_dir(spark, "w11-customers")
    query = apply_change_stream(stream, t, target, scratch_dir(spark, "w11-state"), AS_OF)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return S.conform(spark.read.parquet(latest_version(target, "customers", spark)), S.CUSTOMERS)


# -- W6 ------------------------------------------------------------------------------------

@register("delete_batch", """
WITH del AS (SELECT DISTINCT c.id FROM customers c
             WHERE c.id IN (SELECT id FROM customer_changes WHERE op = 'delete')),
cust AS (SELECT * FROM customers WHERE id NOT IN (SELECT id FROM del)),
gone_cp AS (SELECT id FROM customer_packages WHERE customer_id IN (SELECT id FROM del)),
cp AS (SELECT * FROM customer_packages WHERE id NOT IN (SELECT id FROM gone_cp)),
log AS (SELECT id, subject, CASE WHEN customer_package_id IN (SELECT id FROM gone_cp) THEN NULL
                    ELSE customer_package_id END AS customer_package_id FROM notification_log)
SELECT 'customers' AS table_name, id, company_id AS reference, email AS kept FROM cust
UNION ALL SELECT 'customer_packages', id, CAST(promotion_id AS BIGINT), status FROM cp
UNION ALL SELECT 'notification_log', id, customer_package_id, subject FROM log
UNION ALL SELECT 'outcomes', d.id, NULL, CASE WHEN c.id IS NULL THEN 'not_found' ELSE 'deleted' END
FROM (SELECT DISTINCT id FROM customer_changes WHERE op = 'delete') d LEFT JOIN customers c ON c.id = d.id""")
def _delete_batch(t):
    """Delete the customers the feed deletes; subscriptions cascade,
    their log rows lose the reference. Every row of the three tables after
    it, with what it refers to, and the outcome of each request."""
    dels = pinned(t["customer_changes"].where(F.col("op") == "delete").select("id"), "deletes")
    new, outcomes = CH.delete_batch(t, "customers", dels)
    shown = {"customers": ("company_id", "email"), "customer_packages": ("promotion_id", "status"),
             "notification_log": ("customer_package_id", "subject")}
    parts = [new[n].select(F.lit(n).alias("table_name"), "id", F.col(ref).cast("bigint").alias("reference"), F.col(kept).alias("kept"))
             for n, (ref, kept) in shown.items()]
    parts.append(outcomes.select(F.lit("outcomes").alias("table_name"), "id", F.lit(None).cast("bigint").alias("reference"),
                                 F.col("outcome").alias("kept")))
    return reduce(DataFrame.unionByName, parts)


# -- W7, W8 --------------------------------------------------------------------------------

@register("reference_check", """
SELECT 'subscriptions.customer_id' AS check_name, row_id AS row_key, customer_id AS fk_value
FROM dirty_subscriptions WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM customers)
UNION ALL
SELECT 'subscriptions.package_id', row_id, package_id
FROM dirty_subscriptions WHERE package_id IS NOT NULL AND package_id NOT IN (SELECT id FROM packages)
UNION ALL
SELECT 'package_promotions.package_id', id, package_id
FROM dirty_package_promotions WHERE package_id NOT IN (SELECT id FROM packages)
UNION ALL
SELECT 'package_promotions.promotion_id', id, CAST(promotion_id AS BIGINT)
FROM dirty_package_promotions WHERE promotion_id NOT IN (SELECT id FROM promotions)""")
def _reference_check(t):
    """Rows whose foreign key has no parent."""
    ds, dpp = t["dirty_subscriptions"], t["dirty_package_promotions"]
    return I.orphan_report([
        ("subscriptions.customer_id", ds, "customer_id", t["customers"], "row_id"),
        ("subscriptions.package_id", ds, "package_id", t["packages"], "row_id"),
        ("package_promotions.package_id", dpp, "package_id", t["packages"], "id"),
        ("package_promotions.promotion_id", dpp, "promotion_id", t["promotions"], "id"),
    ]).withColumnRenamed("check", "check_name")


@register("unique_check", """
SELECT 'customers.email' AS check_name, email AS key, CAST(count(*) AS BIGINT) AS n_rows,
       email IN (SELECT email FROM customers) AS in_table
FROM dirty_customers WHERE email IS NOT NULL GROUP BY email
HAVING count(*) > 1 OR email IN (SELECT email FROM customers)
UNION ALL
SELECT 'package_promotions.pair', CAST(package_id AS VARCHAR) || '/' || CAST(promotion_id AS VARCHAR),
       CAST(count(*) AS BIGINT),
       (package_id, promotion_id) IN (SELECT (package_id, promotion_id) FROM package_promotions)
FROM dirty_package_promotions GROUP BY package_id, promotion_id
HAVING count(*) > 1
    OR (package_id, promotion_id) IN (SELECT (package_id, promotion_id) FROM package_promotions)""")
def _unique_check(t):
    """Repeated unique keys within a batch and keys the table holds."""
    return I.duplicate_report([
        ("customers.email", t["dirty_customers"], t["customers"], ["email"]),
        ("package_promotions.pair", t["dirty_package_promotions"], t["package_promotions"],
         ["package_id", "promotion_id"]),
    ]).withColumnRenamed("check", "check_name")


# -- W9, W10 --------------------------------------------------------------------------------

def esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


THEAD = ("<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in L.MAIL_COLUMNS)
         + "</tr></thead><tbody>")


@register("reminder_digest", """
WITH cand AS (""" + CANDIDATES % 30 + """),
n AS (SELECT CAST(count(*) AS VARCHAR) AS n FROM cand)
SELECT 'text' AS section, 0 AS part, CAST(NULL AS TIMESTAMP) AS expires_at,
       CAST(0 AS BIGINT) AS line_key,
       '⚠️ CRM Alert: ' || n || ' subscription(s) expiring within 30 days' AS line FROM n
UNION ALL SELECT 'text', 0, NULL, 1, '' FROM n
UNION ALL SELECT 'text', 2, NULL, 0, '' FROM n
UNION ALL SELECT 'text', 2, NULL, 1, '""" + L.SIGN_OFF + """' FROM n
UNION ALL SELECT 'html', 0, NULL, 0,
       '<p>' || n || ' subscription(s) expiring within <strong>30 days</strong></p>' FROM n
UNION ALL SELECT 'html', 0, NULL, 1, '""" + THEAD + """' FROM n
UNION ALL SELECT 'html', 2, NULL, 0, '</tbody></table>' FROM n
UNION ALL
SELECT 'text', 1, expires_at, cp_id,
       '• ' || customer_name || ' <' || email || '> — ' || package_name || ' — expires '
       || strftime(expires_at, '%Y-%m-%d') || ' (' || CAST(days_left AS VARCHAR) || 'd left)'
FROM cand
UNION ALL
SELECT 'html', 1, expires_at, cp_id,
       '<tr><td>' || """ + esc("customer_name") + """ || '</td><td>' || """ + esc("email") + """
       || '</td><td>' || """ + esc("package_name") + """ || '</td><td>'
       || strftime(expires_at, '%Y-%m-%d') || '</td><td class="'
       || CASE WHEN days_left <= 2 THEN 'urgent' ELSE 'warning' END || '">'
       || CAST(days_left AS VARCHAR) || 'd</td><td>'
       || CASE WHEN price_paid IS NULL THEN '—' ELSE '$' || price_paid END || '</td></tr>'
FROM cand""")
def _reminder_digest(t):
    """The reminder mail of the 30-day horizon, as ordered lines."""
    return L.digest_lines(V.reminder_rows(t, 30, AS_OF), 30)


@register("reminder_cycle", """
WITH cand AS (""" + CANDIDATES % 30 + """),
n AS (SELECT count(*) AS n FROM cand)
SELECT 'summary' AS part, CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS cp_id,
       concat_ws('|', (SELECT count(*) FROM customer_packages WHERE """ + STALE + """), n > 0,
                 CASE WHEN n = 0 THEN 'nothing_expiring' ELSE '' END, n, 'admin@example.com') AS told FROM n
UNION ALL
SELECT 'log', (SELECT max(id) FROM notification_log) + row_number() OVER (ORDER BY expires_at, cp_id), cp_id,
       'package_expiry|admin@example.com|Package Expiry Alert - 30 day horizon|true' FROM cand
UNION ALL
SELECT 'subscription', id, NULL, CASE WHEN """ + STALE + """ THEN 'expired|' || strftime({AS_OF}, '%Y-%m-%d %H:%M:%S')
       ELSE status || '|' || strftime(updated_at, '%Y-%m-%d %H:%M:%S') END FROM customer_packages""")
def _reminder_cycle(t):
    """One reminder run at a 30-day horizon: its summary, the log rows it
    appends, and every subscription as it leaves it (its mail is W9's)."""
    run = L.reminder_cycle(t, 30, "admin@example.com", AS_OF)
    none = F.lit(None).cast("bigint").alias("cp_id")
    summary = run["summary"].select(F.lit("summary").alias("part"), F.lit(0).cast("bigint").alias("id"), none, F.concat_ws(
        "|", "auto_expired", "email_prepared", F.coalesce("reason", F.lit("")), "recipients", "admin_email").alias("told"))
    log = run["log_rows"].select(F.lit("log").alias("part"), "id", F.col("customer_package_id").alias("cp_id"),
                                 F.concat_ws("|", "type", "recipient_email", "subject", "success").alias("told"))
    subs = run["customer_packages"].select(F.lit("subscription").alias("part"), "id", none, F.concat_ws(
        "|", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")).alias("told"))
    return summary.unionByName(log).unionByName(subs)


# -- maintained counts, expiry histogram -------------------------------------------------------

_AFTER_SQL = """
WITH patched AS (""" + _patched_customers_sql(True) + """),
kept AS (
  SELECT * REPLACE (CASE WHEN status = 'active' AND expires_at < {AS_OF} THEN 'expired' ELSE status END AS status)
  FROM customer_packages WHERE customer_id IN (SELECT id FROM patched))
SELECT * FROM """ + ", ".join(
    f"({re.sub(r'customer_packages', 'kept', re.sub(r'FROM customers', 'FROM patched', METRIC_SQL[n]))}) AS m{i}"
    for i, n in enumerate(M.STAT_COLUMNS))


def _replayed_counts(t):
    """The tables and the count table after the change feed and W1: of the
    whole tables only the first counts are taken."""
    counts = pinned(MC.initial_counts(t), "counts")
    new, outcomes = replay_changes(t, t["customer_changes"], "customers", AS_OF)
    gone = outcomes.where("outcome = 'deleted'").select(F.col("id").alias("customer_id"))
    touched = outcomes.where("outcome IN ('updated', 'deleted')").select("id")
    before, after = MC.touched_images(t["customers"], new["customers"], touched)
    lost = t["customer_packages"].join(gone, "customer_id", "left_semi")
    counts = pinned(MC.fold_counts(counts, ("customers", before, after), ("customer_packages", lost, None)), "counts")
    stale = new["customer_packages"].where((F.col("status") == "active") & (F.col("expires_at") < at(AS_OF)))
    counts = MC.fold_counts(counts, ("customer_packages", stale, L.auto_expire(stale, AS_OF)))
    return overlay(new, customer_packages=L.auto_expire(new["customer_packages"], AS_OF)), pinned(counts, "counts")


@register("maintained_dashboard", _AFTER_SQL)
def _maintained_dashboard(t):
    """A1-A11 from counts that the changes of customers, their cascades and
    W1 were folded into; only the edge hours of the horizons are read."""
    new, counts = _replayed_counts(t)
    return MC.maintained_dashboard(counts, new, AS_OF)


@register("expiry_horizons", """
WITH h AS (SELECT id AS horizon_id, CAST(id % 1021 AS DECIMAL(20,6)) * 0.137 AS days FROM packages)
SELECT h.horizon_id, CAST(h.days AS DOUBLE) AS days,
       (SELECT count(*) FROM customer_packages cp WHERE cp.status = 'active'
        AND cp.expires_at BETWEEN {AS_OF} AND {AS_OF} + to_microseconds(CAST(h.days * 86400000000 AS BIGINT))) AS expiring
FROM h""")
def _expiry_horizons(t):
    """A6 and A7 for a horizon of its own, in fractions of days, for each
    package: prefix sums by hour, and the rows of the edge hours."""
    horizons = t["packages"].select(F.col("id").alias("horizon_id"),
                                    ((F.col("id") % 1021).cast("decimal(20,6)") * F.lit(Decimal("0.137"))).cast("decimal(20,6)").alias("days"))
    hist = MC.expiry_histogram(t["customer_packages"])
    return MC.expiring_counts(hist, t["customer_packages"], horizons, AS_OF)
