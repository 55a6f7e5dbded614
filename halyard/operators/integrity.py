"""Reference (W7) and uniqueness (W8) audits.

Both are joins and aggregates: orphans are a left anti join of the non-NULL
foreign keys against the parent keys; duplicates are a count per key that
is combined map-side before the shuffle, so a key held by a third of all
rows still costs one partial row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.operators.joins import present_in


def all_present(keys: list[str]) -> Column:
    """Every key column non-NULL (a NULL never clashes, as in SQL)."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def orphans(child: DataFrame, parent: DataFrame, fk: str, parent_key: str = "id") -> DataFrame:
    """Rows of ``child`` whose non-NULL ``fk`` has no parent row. The
    parent keys are looked up through the child's keys (see ``present_in``),
    so a large parent is read once and not shuffled when the child is small."""
    found = present_in(child.select(F.col(fk).alias("__pk")),
                       parent.select(F.col(parent_key).alias("__pk")), ["__pk"])
    return (child.where(F.col(fk).isNotNull())
            .join(found, F.col(fk) == F.col("__pk"), "left_anti"))


def orphan_report(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """W7 over several relations: ``(check, row_key, fk_value)`` rows for
    each ``(name, child, fk, parent, child_key)``.

    One read a table and one join for all: each child's references are
    stacked as (check, parent, key, row), the parents' keys as (parent, key),
    and the first are joined with the second; what finds none is left. Nothing is measured and no
    job runs while the plan is built: AQE broadcasts the parents' keys if they
    are few and splits a reference that very many rows hold."""
    children: dict[int, tuple[DataFrame, list]] = {}
    parents: dict[int, DataFrame] = {}
    for name, child, fk, parent, key in checks:
        at = next((k for k, df in parents.items() if df is parent), len(parents))
        parents[at] = parent
        children.setdefault(id(child), (child, []))[1].append((name, fk, at, key))
    rows = []
    for child, refs in children.values():
        each = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(at).alias("__parent"),
                                  F.col(fk).cast("bigint").alias("fk_value"), F.col(key).cast("bigint").alias("row_key"))
                         for name, fk, at, key in refs])
        rows.append(child.select(F.explode(each).alias("r")).select("r.*").where(F.col("fk_value").isNotNull()))
    keys = [df.select(F.lit(at).alias("__at"), F.col("id").cast("bigint").alias("__id")) for at, df in parents.items()]
    stacked, known = reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, keys)
    # A left join, since an anti join is pushed below the union, once a child.
    return (stacked.join(known, (F.col("__parent") == F.col("__at")) & (F.col("fk_value") == F.col("__id")), "left")
            .where(F.col("__id").isNull()).select("check", "row_key", "fk_value"))


def key_text(keys: list[str]):
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def duplicate_report(checks: list[tuple[str, DataFrame, DataFrame | None, list[str]]]) -> DataFrame:
    """W8 for several ``(name, batch, table, keys)``: ``(check, key,
    n_rows, in_table)`` where ``n_rows`` counts the batch rows holding the
    key and ``in_table`` says the table holds it too. A key is reported
    when the batch repeats it or the table already has it."""
    parts = []
    for name, batch, table, keys in checks:
        counts = (batch.where(all_present(keys))
                  .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")))
        if table is not None:
            held = present_in(batch, table.select(*keys), keys).withColumn("__held", F.lit(True))
            counts = counts.join(held, keys, "left")
            in_table = F.coalesce("__held", F.lit(False))
        else:
            in_table = F.lit(False)
        counts = counts.withColumn("in_table", in_table)
        parts.append(counts.where((F.col("n_rows") > 1) | F.col("in_table")).select(
            F.lit(name).alias("check"), key_text(keys).alias("key"),
            "n_rows", "in_table"))
    return reduce(DataFrame.unionByName, parts)
