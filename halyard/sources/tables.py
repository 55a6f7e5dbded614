"""Table sources and sinks: declared-schema loads (S1), appends (S5),
insert-if-absent (S6) and versioned table writes.

Parquet tables have no UPDATE, MERGE or DELETE, so a write computes the new
table and writes it to a new versioned folder; readers switch by reading
the latest complete version.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from halyard.functions.expressions import EXPIRY_TYPE
from halyard.functions.time import at
from halyard.operators.ids import ID_SEQUENCES, assign_ids, largest_id
from halyard.operators.integrity import all_present
from halyard.operators.joins import present_in
from halyard.session import pinned
from halyard.sources import schemas as S


def _versions(spark: SparkSession, path: str, name: str) -> list[tuple[int, str, bool]]:
    """``(version, folder, complete)`` of a versioned table, listed through
    the Hadoop FileSystem API so shared cluster storage works as local disk."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    out = []
    for st in fs.listStatus(base):
        leaf = st.getPath().getName()
        if st.isDirectory() and leaf.startswith("v=") and leaf[2:].isdigit():
            done = fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))
            out.append((int(leaf[2:]), st.getPath().toString(), done))
    return sorted(out)


def latest_version(path: str, name: str, spark: SparkSession | None = None,
                   below: int | None = None) -> str | None:
    """The newest complete version of table ``name`` (below ``below``)."""
    spark = spark or SparkSession.getActiveSession()
    done = [(v, p) for v, p, ok in _versions(spark, path, name)
            if ok and (below is None or v < below)]
    return done[-1][1] if done else None


def _file(spark: SparkSession, path: str):
    """``(file system, path)`` of a small side file of a table or a stream."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_number(spark: SparkSession, path: str) -> int | None:
    """The number a side file holds; None without the file or a whole number."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        line = stream.readLine()
    finally:
        stream.close()
    return int(line) if line and line.isdigit() else None


def write_number(spark: SparkSession, path: str, number: int) -> None:
    fs, p = _file(spark, path)
    stream = fs.create(p, True)
    try:
        stream.writeBytes(f"{number}\n")
    finally:
        stream.close()


# Side file of a table version: the last id issued in the table so far.
LAST_ID = "_LAST_ID"


def last_issued_id(spark: SparkSession, path: str, name: str, below: int | None = None) -> int | None:
    """The last id issued in a versioned table, up to its newest complete
    version (below ``below``); None without a version. A version whose side
    file is missing (its writer was lost after the rows) is read for it."""
    least = 0
    for v, folder, ok in reversed(_versions(spark, path, name)):
        if not ok or (below is not None and v >= below):
            continue
        mark = read_number(spark, f"{folder}/{LAST_ID}")
        if mark is not None:
            return max(mark, least)
        least = max(least, largest_id(spark.read.schema(S.TABLES[name]).parquet(folder)))
    return least or None


def drop_old_versions(spark: SparkSession, path: str, name: str, keep: int) -> None:
    """Delete all but the newest ``keep`` (at least 2) complete versions and
    what unfinished versions older than those left. Readers of an older
    version fail, so keep as many as a reader may still hold."""
    found = _versions(spark, path, name)
    done = [v for v, _p, ok in found if ok][-max(2, keep):]
    for v, folder, _ok in found:
        if done and v < done[0]:
            fs, p = _file(spark, folder)
            fs.delete(p, True)


def load_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet",
               options: dict | None = None, version: int | None = None) -> DataFrame:
    """One table with its declared schema (never inferred). A table
    written by ``write_table`` is read at its newest complete version, or at
    ``version``.
    ``fmt`` may be any DataFrameReader format; for ``jdbc`` pass
    ``url``/``dbtable`` in ``options`` and ``path`` is ignored."""
    reader = spark.read.format(fmt).options(**(options or {}))
    schema = S.TABLES[name]
    if fmt == "jdbc":
        return S.conform(reader.load(), schema)
    if version is not None:
        where = os.path.join(path, name, f"v={version}")
    else:
        where = latest_version(path, name, spark) or os.path.join(path, name)
    return S.conform(reader.schema(schema).load(where), schema)


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                options: dict | None = None) -> dict[str, DataFrame]:
    """The seven tables under ``path`` (one folder each). Where tables
    have versions, ``id_sequences`` (table_name, last_id) is added: new ids
    follow these. Where there is a commit record (``publish``), the tables are
    those it names; versions written since, by a writer that has not finished
    or was lost, are not seen."""
    now = current_commit(spark, path) if fmt != "jdbc" else None
    at = now[1] if now else {}
    t = {name: load_table(spark, path, name, fmt, options, at.get(name)) for name in S.TABLES}
    if fmt != "jdbc":
        last = [(name, last_issued_id(spark, path, name)) for name in S.TABLES]
        last = [(name, n) for name, n in last if n is not None]
        if last:
            t[ID_SEQUENCES] = spark.createDataFrame(last, "table_name string, last_id bigint")
    return t


def write_table(df: DataFrame, path: str, name: str, version: int | str,
                partition_by: list[str] | None = None,
                sort_by: list[str] | None = None) -> str:
    """Write ``df`` as version ``version`` of table ``name``; overwriting the
    same version is idempotent (a retried batch rewrites the same folder).
    ``partition_by`` lays the table out in folders (e.g. subscriptions by
    ``status``, so expiry scans read only active rows); ``sort_by`` sorts
    each file (e.g. by ``expires_at``) so parquet row-group statistics let
    a horizon filter skip most of it. Neither changes the rows.

    The last id issued is kept beside the rows: the largest of this version
    (observed while it is written) and of the versions before it."""
    spark = df.sparkSession
    target = os.path.join(path, name, f"v={version}")
    seen = Observation()
    numbered = name in S.TABLES and "id" in df.columns and str(version).isdigit()
    if numbered:
        df = df.observe(seen, F.max("id").alias("last_id"))
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    if numbered:
        before = last_issued_id(spark, path, name, below=int(version)) or 0
        write_number(spark, f"{target}/{LAST_ID}", max(before, seen.get.get("last_id") or 0))
    return target


# -- commit records: several tables, one switch ------------------------------------------

# A record is a file ``c=<number>`` in this folder: a line ``table=version`` for
# each versioned table, and a last line that says the record is whole.
COMMITS, WHOLE = "_commits", "end"


class CommitConflict(RuntimeError):
    """Another writer published since the tables were read."""


def _record(spark: SparkSession, path: str) -> dict[str, int] | None:
    """The versions a record file names; None if it is not whole."""
    fs, p = _file(spark, path)
    reader = spark.sparkContext._jvm.java.io.BufferedReader(
        spark.sparkContext._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    lines = []
    try:
        while (line := reader.readLine()) is not None:
            lines.append(line)
    finally:
        reader.close()
    if not lines or lines[-1] != WHOLE:
        return None
    return {name: int(v) for name, v in (line.split("=") for line in lines[:-1])}


def current_commit(spark: SparkSession, path: str) -> tuple[int, dict[str, int]] | None:
    """``(number, {table: version})`` of the newest whole record, if any."""
    fs, p = _file(spark, f"{path.rstrip('/')}/{COMMITS}")
    if not fs.exists(p):
        return None
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    for n in sorted((int(x[2:]) for x in names if x.startswith("c=") and x[2:].isdigit()), reverse=True):
        versions = _record(spark, f"{path.rstrip('/')}/{COMMITS}/c={n}")
        if versions is not None:
            return n, versions
    return None


def write_commit(spark: SparkSession, path: str, number: int, versions: dict[str, int], replace: bool = False) -> None:
    """Write record ``number`` under another name and move it into place, so
    that readers see it whole or not at all. A record that is there already
    stays (``CommitConflict``), unless ``replace`` (a retried write)."""
    jvm = spark.sparkContext._jvm
    base = f"{path.rstrip('/')}/{COMMITS}"
    fs, done = _file(spark, f"{base}/c={number}")
    _fs, part = _file(spark, f"{base}/_part-{number}-{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.writeBytes("".join(f"{name}={v}\n" for name, v in sorted(versions.items())) + WHOLE + "\n")
    finally:
        stream.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE if replace else options.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            part.toUri() if part.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
        ).rename(fs.makeQualified(part), fs.makeQualified(done), how)
    except Exception as exc:
        fs.delete(part, False)
        if fs.exists(done):
            raise CommitConflict(f"record {number} of {path} is there already") from exc
        raise


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], base: int | None = None,
            version: int | None = None, number: int | None = None) -> int:
    """Write ``tables`` as new versions, then one commit record that names
    the current version of every table: ``load_tables`` shows all of them or
    none, wherever the writer is cut short. Returns the record's number.

    ``base`` is the number of the record that the tables were made from
    (``current_commit``); if there is another since, ``CommitConflict`` is
    raised and nothing is shown, so two writers that start together cannot
    both issue the same ids. A retried write passes the ``version`` and
    ``number`` it had and writes the same folders and record again."""
    now = current_commit(spark, path)
    at = now[0] if now else 0
    if base is not None and number is None and at != base:
        raise CommitConflict(f"record {at} of {path} was published after {base}")
    found = {name: _versions(spark, path, name) for name in {*S.TABLES, *tables}}
    if version is None:
        version = 1 + max((v for vs in found.values() for v, _p, _ok in vs), default=0)
    known = dict(now[1]) if now else {name: max(v for v, _p, ok in vs if ok) for name, vs in found.items() if any(ok for *_, ok in vs)}
    for name, df in tables.items():
        write_table(df, path, name, version)
    write_commit(spark, path, at + 1 if number is None else number, {**known, **{name: version for name in tables}},
                 replace=number is not None)
    return at + 1 if number is None else number


def append_rows(df: DataFrame, path: str) -> None:
    """One append of all rows (not one insert per row)."""
    df.write.mode("append").parquet(path)


# -- S5 -----------------------------------------------------------------------------

def log_subject(days) -> str:
    return f"Package Expiry Alert - {days} day horizon"


def notification_rows(candidates: DataFrame, recipient: str, days, as_of,
                      start_id: int, success: bool = True,
                      error_message: str | None = None) -> DataFrame:
    """One ``notification_log`` row per reminded subscription, ids after
    ``start_id`` in the order of the digest (expiry, then subscription id)."""
    rows = candidates.select(
        F.lit(EXPIRY_TYPE).alias("type"), F.lit(recipient).alias("recipient_email"),
        F.lit(log_subject(days)).alias("subject"), at(as_of).alias("sent_at"),
        F.lit(None).cast("bigint").alias("customer_id"),
        F.col("cp_id").alias("customer_package_id"), F.lit(success).alias("success"),
        F.lit(error_message).cast("string").alias("error_message"),
        F.col("expires_at").alias("__exp"))
    rows = assign_ids(rows, start_id, ["__exp", "customer_package_id"])
    return S.conform(rows, S.NOTIFICATION_LOG)


def notification_append(log: DataFrame, candidates: DataFrame, recipient: str, days,
                        as_of, last_id: int | None = None) -> DataFrame:
    """S5 on a table: the log after appending the new rows, numbered after
    ``last_id`` (default: the largest id of the log)."""
    start = largest_id(log) if last_id is None else last_id
    new = notification_rows(candidates, recipient, days, as_of, start)
    return log.unionByName(new)


# -- S6 -----------------------------------------------------------------------------

def first_per_key(rows: DataFrame, on: list[str], order_by: str) -> DataFrame:
    """Of several rows with the same key keep the first by ``order_by``.
    ``min`` of a struct led by the order column is combined map-side, so a
    hot key costs one row per map task before the shuffle, never one
    collected group."""
    others = [c for c in rows.columns if c not in on and c != order_by]
    first = F.min(F.struct(F.col(order_by), *[F.col(c) for c in others])).alias("__first")
    return (rows.groupBy(*on).agg(first)
            .select(*on, *[F.col("__first")[c].alias(c) for c in [order_by] + others])
            .select(*rows.columns))


def insert_if_absent(existing: DataFrame, new: DataFrame, on: list[str],
                     order_by: str, id_col: str = "id", last_id: int | None = None) -> DataFrame:
    """Rows of ``new`` whose natural key is absent from ``existing`` (the
    first by ``order_by`` when the batch repeats a key), numbered after
    ``last_id`` (default: the table's largest id)."""
    # The keys of the batch the table holds (through the broadcast batch keys
    # when the batch is under the bound: the table is read, not shuffled).
    new = pinned(new, "seed-rows")
    held = present_in(new, existing.select(*on).where(all_present(on)), on)
    fresh = first_per_key(new, on, order_by).join(held, on, "left_anti")
    start = largest_id(existing, id_col) if last_id is None else last_id
    return assign_ids(fresh, start, [order_by], id_col)
