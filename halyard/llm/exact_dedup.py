"""Exact deduplication: 128-bit content hash, smallest id, bytes compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import SPACE, fresh, numbered, pin, text_or_empty


def _first() -> Column:
    """The smallest (doc_id, row), null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     digest: Callable[[Column], Column] = F.md5, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256, h, row.

    Texts are equal when identical after each run of white space became one
    space; a null text counts as empty. Rows are grouped by the MD5 of that
    text *and* by the text itself, so Spark compares the bytes inside a hash
    group and a collision makes two groups. Copies meet in the map-side part
    of the aggregation, so a text that a third of all rows share sends one row
    per task through the shuffle. Only hash, id and count are kept of each
    distinct text; rows find their group by hash. Hashes that two different
    texts share (none in practice; ``digest`` lets tests force them) are
    joined by hash and text instead.

    ``row`` is a unique number of each row (``row_col``, or one given here and
    written). Of equal texts one row is kept: that of the smallest doc_id,
    then of the smallest number. Defined results: empty texts are one group;
    a null id never becomes keep_id while the group has another id; of a
    group of null ids, or of rows that repeat the smallest id, one row is
    kept; an empty table gives an empty table.
    """
    norm = F.regexp_replace(text_or_empty(text_col), SPACE, " ")
    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), number.alias("row")).withColumn(
        "h", digest(F.col("norm")))
    narrow = pin(rows.select("doc_id", "h", "row"), "exact-rows")
    texts = rows.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"))
    found = pin(texts.select("h", "group_size", F.sha2("norm", 256).alias("text_sha256")), "exact-groups")
    shared = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    out = narrow.join(narrow.groupBy("h").agg(_first()).join(found, "h"), "h")
    if shared.take(1):
        shared = pin(shared, "exact-collisions")
        held = pin(rows.join(shared, "h", "left_semi"), "exact-collided")
        exact = held.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), _first())
        exact = exact.withColumn("text_sha256", F.sha2("norm", 256))
        out = out.join(shared, "h", "left_anti").unionByName(held.join(exact, ["h", "norm"]).drop("norm"))
    return out.select("doc_id", F.col("first")["doc_id"].alias("keep_id"), "group_size",
                      (F.col("row") == F.col("first")["row"]).alias("kept"), "text_sha256", "h", "row")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops, all columns
    kept. Rows are numbered once, and only the dropped numbers are joined, so
    rows with null or repeated ids go as well; an empty table stays empty."""
    rows, row = numbered(docs, id_col)
    gone = pin(exact_duplicates(rows, id_col, text_col, row_col=row).filter(~F.col("kept")).select("row"), "exact-dropped")
    name = fresh(rows, "gone_row")
    gone = gone.withColumnRenamed("row", name)
    return rows.join(gone, rows[row] == gone[name], "left_anti").drop(row)
