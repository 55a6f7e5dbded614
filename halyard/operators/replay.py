"""W5 and W11 change by change: a batch of patches and deletes applied as if
one after the other by sequence, with an outcome for each change.

Only unique keys tie the changes of different rows together; they are
resolved first (``operators.claims``). What is left is per row: the first
delete that nothing restricts, and for each field the last patch that stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.time import at
from halyard.operators.claims import CLAIM, FREE, HOLD, resolve_claims
from halyard.operators.joins import is_small, present_in, small_side
from halyard.operators.validation import VALIDATORS
from halyard.session import pinned
from halyard.sources import schemas as S
from halyard.sources.fixtures import overlay

OUTCOMES = ["updated", "deleted", "rejected", "not_found", "restricted"]


def patch_fields(changes: DataFrame) -> list[str]:
    return [c[4:] for c in changes.columns if c.startswith("set_")]


def writable_fields(changes: DataFrame, entity: str) -> list[str]:
    return [f for f in patch_fields(changes) if f in S.WRITABLE[entity]]


def any_field_set(fields: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"set_{f}"), F.lit(False)) for f in fields], F.lit(False))


def apply_patches(table: DataFrame, entity: str, p: DataFrame, as_of, small: bool | None) -> DataFrame:
    """``table`` with the fields that ``p`` (id, field, set_field, ...; one
    row an id) sets, and ``updated_at = as_of`` on the rows it names. Patches
    under the bound are broadcast: the table is read once, in place."""
    fields = writable_fields(p, entity)
    p = p.select(F.col("id").alias("__pid"), *[F.col(f).alias(f"__new_{f}") for f in fields],
                 *[F.col(f"set_{f}").alias(f"__set_{f}") for f in fields])
    joined = table.join(small_side(p, small=small), table["id"] == p["__pid"], "left")
    hit, out = F.col("__pid").isNotNull(), []
    for f in S.TABLES[entity]:
        c = F.col(f.name)
        if f.name in fields:
            c = F.when(hit & F.col(f"__set_{f.name}"), F.col(f"__new_{f.name}").cast(f.dataType)).otherwise(c)
        elif f.name == "updated_at":
            c = F.when(hit, at(as_of).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return joined.select(out)


def claimed_key(entity: str, fields: list[str]) -> str | None:
    """The unique column that a patch of ``fields`` may set, if any."""
    keys = [k for k in S.UNIQUE_KEYS.get(entity, []) if any(c in fields for c in k)]
    if not keys:
        return None
    if len(keys) > 1 or len(keys[0]) > 1:
        raise ValueError(f"{entity}: patches of one unique column are resolved, not of {keys}")
    return keys[0][0]


def _taken(changes: DataFrame, small: bool | None, written: bool = False) -> tuple[DataFrame, bool]:
    """``changes`` with an ``op``, written once unless they are a written
    table (``written``), and whether they are under the broadcast bounds."""
    if "op" not in changes.columns:
        changes = changes.withColumn("op", F.lit("patch"))
    if not written:
        changes = pinned(changes, "replay-changes")
    return changes, is_small(changes) if small is None else small


def judged_changes(t, changes: DataFrame, entity: str, small: bool | None = None) -> DataFrame:
    """``changes`` with ``outcome`` and ``errors`` (codes, ``|``-joined) of
    each, written once. See ``replay_changes``."""
    return _judged(t, *_taken(changes, small), entity)


def _judged(t, changes: DataFrame, small: bool, entity: str) -> DataFrame:
    from halyard.operators.changes import _flag_missing_parents
    table, fields = t[entity], writable_fields(changes, entity)
    patch, codes = F.col("op") == "patch", F.col("errors")
    none = F.array().cast("array<string>")
    checked = VALIDATORS[entity](changes, partial=True, checked_only=True).checked()
    checked = checked.withColumn("errors", F.when(F.col("op") == "delete", none).when(
        ~patch, F.array(F.lit("op:unknown"))).when(
        (F.size(codes) == 0) & ~any_field_set(fields), F.array(F.lit("no_fields"))).otherwise(codes))
    for c in ("seq", "id"):
        checked = checked.withColumn("errors", F.when(F.col(c).isNull(), F.array_append(codes, F.lit(f"{c}:required"))).otherwise(codes))
    checked = checked.withColumn("__rules", F.size("errors"))
    checked = _flag_missing_parents(checked, t, entity, {
        f: F.when(patch & F.col(f"set_{f}"), F.col(f)) for f in fields}, small, changes)

    there = present_in(changes.select(F.col("id").alias("__tid")), table.select(F.col("id").alias("__tid")), ["__tid"], small)
    checked = checked.join(there, F.col("id") == F.col("__tid"), "left")
    dels = changes.where((F.col("op") == "delete") & F.col("seq").isNotNull())
    blocked = [present_in(dels.select(F.col("id").alias("__bid")), t[child].select(F.col(col).alias("__bid")), ["__bid"], small)
               for child, col, parent, rule in S.FOREIGN_KEYS if parent == entity and rule == "restrict" and child in t]
    if blocked:
        held = reduce(DataFrame.unionByName, blocked).distinct()
        checked = checked.join(small_side(held, small=small), F.col("id") == F.col("__bid"), "left")
    else:
        checked = checked.withColumn("__bid", F.lit(None).cast("bigint"))
    first = dels.groupBy(F.col("id").alias("__did")).agg(F.min("seq").alias("__dseq"))
    checked = checked.join(small_side(first, small=small), F.col("id") == F.col("__did"), "left")
    gone = F.coalesce(F.col("__bid").isNull() & (F.col("seq") > F.col("__dseq")), F.lit(False))
    outcome = (F.when(F.col("__rules") > 0, "rejected")
               .when(F.col("__tid").isNull() | gone, "not_found")
               .when(~patch & F.col("__bid").isNotNull(), "restricted")
               .when(~patch, "deleted")
               .when(F.size("errors") > 0, "rejected").otherwise("updated"))
    checked = checked.withColumn("outcome", outcome).drop("__tid", "__bid", "__did", "__dseq", "__rules")
    key = claimed_key(entity, fields)
    if key is None:
        return pinned(checked.withColumn("errors", F.concat_ws("|", "errors")), "replay-judged")
    checked = pinned(checked, "replay-checked")
    claims = checked.where((F.col("outcome") == "updated") & F.col(f"set_{key}") & F.col(key).isNotNull()).select(
        "id", "seq", F.col(key).alias("key"), F.lit(CLAIM).alias("kind"))
    asked = claims.select("key").distinct()
    holds = table.select(F.col("id").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("seq"), F.col(key).alias("key"),
                         F.lit(HOLD).alias("kind")).join(small_side(asked, small=small), "key", "left_semi")
    frees = checked.where(F.col("outcome") == "deleted").select("id", "seq", F.lit(None).cast("string").alias("key"),
                                                               F.lit(FREE).alias("kind"))
    refused = resolve_claims(claims.unionByName(holds.select("id", "seq", "key", "kind")).unionByName(frees)).where(
        ~F.col("stands")).select(F.col("seq").alias("__rseq"))
    checked = checked.join(refused, F.col("seq") == F.col("__rseq"), "left")
    lost = F.col("__rseq").isNotNull()
    return pinned(checked.withColumn("outcome", F.when(lost, "rejected").otherwise(F.col("outcome")))
                  .withColumn("errors", F.concat_ws("|", "errors", F.when(lost, F.lit(f"unique:{key}")))).drop("__rseq"), "replay-judged")


def last_set(judged: DataFrame, entity: str) -> DataFrame:
    """(id, field, set_field, ...): of each row the last value that a patch
    that stands set. Combined map-side, so a row with a third of all changes
    is one partial row per task."""
    aggs = []
    for f in writable_fields(judged, entity):
        sets = F.coalesce(F.col(f"set_{f}"), F.lit(False))
        aggs += [F.max_by(F.col(f), F.when(sets, F.col("seq"))).alias(f), F.bool_or(sets).alias(f"set_{f}")]
    return judged.where(F.col("outcome") == "updated").groupBy("id").agg(*aggs)


def replay_changes(t, changes: DataFrame, entity: str, as_of, small: bool | None = None, written: bool = False):
    """Apply ``changes`` (seq, id, op ``patch`` or ``delete``, and for each
    patched field ``f`` the value and ``set_f``) in order of ``seq``, which is
    unique. Returns ``(new_tables, outcomes)``; outcomes has (seq, id, op,
    outcome, errors), a row for each change:

    * ``rejected``: a rule broken, nothing set, a parent that does not exist,
      or a unique key that another row holds at that moment (one freed,
      swapped or given up earlier in the batch does not clash);
    * ``not_found``: no such row, or an earlier change deleted it;
    * ``restricted``: a delete of a row that is still referenced (it stays,
      and later changes apply); ``updated`` and ``deleted``.

    A rejected patch changes nothing, whatever stands of the others. Deletes
    reach the child tables by their rules (W6). Changes without a sequence or
    an id are rejected; an empty batch changes nothing. ``written``: the
    changes are a written table, which need not be written again."""
    from halyard.operators.changes import delete_batch
    changes, small = _taken(changes, small, written)     # bounds the rows patched and deleted, too
    judged = _judged(t, changes, small, entity)
    table = apply_patches(t[entity], entity, last_set(judged, entity), as_of, small)
    gone = judged.where(F.col("outcome") == "deleted").select("id")
    new, _ = delete_batch(overlay(t, **{entity: table}), entity, gone, small=small)
    return new, judged.select("seq", "id", "op", "outcome", "errors")
