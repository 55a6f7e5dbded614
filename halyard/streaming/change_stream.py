"""A stream of patches and deletes folded to final state with
Structured Streaming.

The fold is the same aggregate as the batch form (``fold_changes``): per id
the latest set value of each field by sequence, the delete flag and the
patch count. Its state holds one aggregation buffer per distinct id, so it
grows with ids, not with changes, and a late patch cannot overtake a later
one (the sequence decides, not arrival), so no watermark is needed.

Two ways to consume it:

* ``fold_stream(...)`` returns the streaming DataFrame (``update`` or
  ``complete`` output mode) for any sink;
* ``apply_change_stream(...)`` runs it with ``foreachBatch``: each micro-batch
  of folded ids is applied (W6 then W5). The entity, every table that its
  deletes reach (cascaded or nulled rows) and the outcomes are written as one
  version each, above all versions found when the stream first started, and
  shown by one commit record; a retried batch rewrites the same folders and
  record (idempotent on ``batch_id``);
* ``replay_change_stream(...)`` applies the changes one by one, without the
  fold, and tells the outcome of each;
* ``apply_change_stream(..., buckets=N)`` is the layout for large targets:
  the tables are partitioned by a hash bucket of the id, and a micro-batch
  reads and rewrites only the buckets its rows fall in (dynamic partition
  overwrite of contents staged under the checkpoint folder). Children are
  written before the entity, so a batch cut short finds its deletes again.
  The folded rows are absolute states, so re-applying a batch after a failure
  gives the same buckets. Readers may see a batch half applied: it is not
  atomic. The buckets of rows that hold a unique key now asked for are read
  as well, so keys are checked over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.changes import apply_folded, fold_changes, marked_changes, reached_rows
from halyard.sources import schemas as S
from halyard.sources.fixtures import overlay
from halyard.session import scratch_dir, scratch_scope
from halyard.operators.replay import replay_changes
from halyard.sources.tables import (_versions, current_commit, drop_old_versions, latest_version, publish,
                                    read_number, write_number, write_table)


def change_source(spark: SparkSession, path: str, schema=S.CUSTOMER_CHANGES,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Change rows arriving as parquet files in ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def fold_stream(changes: DataFrame, entity: str = "customers") -> DataFrame:
    """The folded state as a streaming aggregation; patches that break a rule
    by themselves take no part in the fold and are counted as rejected."""
    return fold_changes(marked_changes(changes, entity))


def reached_tables(entity: str) -> list[str]:
    """The tables that deletes of ``entity`` may change, by the foreign keys."""
    out: list[str] = []

    def walk(parent: str) -> None:
        for child, _col, p, rule in S.FOREIGN_KEYS:
            if p == parent and rule != "restrict":
                if child not in out:
                    out.append(child)
                if rule == "cascade":
                    walk(child)
    walk(entity)
    return out


def outcome_table(entity: str) -> str:
    return f"{entity}_outcomes"


BUCKET = "id_bucket"


def id_bucket(buckets: int, col: str = "id") -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(buckets)).cast("int")


def read_bucketed(spark: SparkSession, target_path: str, entity: str,
                  only: list[int] | None = None) -> DataFrame:
    """The current table of the bucketed layout, or of some of its buckets
    (a partition filter: the other buckets are not read)."""
    df = spark.read.parquet(f"{target_path.rstrip('/')}/{entity}")
    if only is not None:
        df = df.where(F.col(BUCKET).isin(only))
    return S.conform(df.drop(BUCKET), S.TABLES[entity])


def _pin(batch: DataFrame, batch_id: int) -> DataFrame:
    """The folded micro-batch written once under the checkpoint folder and
    read back: one row per changed id, read several times by the apply (its
    bound, the deletes, the patches) without re-running the stateful
    aggregation, and fixed if an executor is lost mid-apply."""
    spark = batch.sparkSession
    path = scratch_dir(spark, f"change-batch-{batch_id}")
    batch.write.parquet(path)
    return spark.read.parquet(path)


def _bucketed_apply(t, target_path: str, entity: str, as_of, buckets: int, first: int):
    def apply(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            apply_pinned(_pin(batch, batch_id), batch_id)

    def apply_pinned(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(target_path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

        def start(name: str) -> None:
            # A first write that was cut short left no _SUCCESS and is made anew.
            path = f"{target_path.rstrip('/')}/{name}"
            if not fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                (t[name].withColumn(BUCKET, id_bucket(buckets)).write.mode("overwrite")
                 .partitionBy(BUCKET).parquet(path))

        def buckets_of(ids: DataFrame) -> list[int]:
            # At most ``buckets`` numbers.
            return sorted(r[0] for r in ids.select(id_bucket(buckets).alias("b")).distinct().collect())

        start(entity)
        ids = batch.select("id")
        for key in (k for keys in S.UNIQUE_KEYS.get(entity, []) for k in keys if f"set_{k}" in batch.columns):
            # The rows that hold a key now asked for, in whatever bucket.
            asked = batch.where(F.col(f"set_{key}") & F.col(key).isNotNull()).select(key).distinct()
            ids = ids.unionByName(read_bucketed(spark, target_path, entity).select("id", key).join(asked, key, "left_semi").select("id"))
        touched = {entity: buckets_of(ids)}
        if not touched[entity]:
            return
        cur = overlay(t, **{entity: read_bucketed(spark, target_path, entity, touched[entity])})
        gone = cur[entity].join(batch.where("deleted").select("id"), "id", "left_semi").select("id")
        reached = [c for c in reached_tables(entity) if c in t]
        if reached and gone.take(1):
            for name in reached:
                start(name)
            whole = overlay(cur, **{n: read_bucketed(spark, target_path, n) for n in reached})
            for name, ids in reached_rows(whole, entity, gone).items():
                touched[name] = buckets_of(ids)
            cur = overlay(cur, **{n: read_bucketed(spark, target_path, n, touched[n])
                                  for n in reached if n in touched})
        new, outcomes = apply_folded(cur, batch, entity, as_of)
        write_table(outcomes, target_path, outcome_table(entity), first + batch_id)
        staged = {}
        for name, hit in touched.items():
            if hit:
                staging = scratch_dir(spark, f"{name}-bucket-batch-{batch_id}")
                rows = new[name].withColumn(BUCKET, id_bucket(buckets))
                rows.write.partitionBy(BUCKET).parquet(staging)
                staged[name] = spark.read.schema(rows.schema).parquet(staging)    # may hold no row
        # Last come the tables that the others are found through, the entity at the end.
        for name in reversed(staged):
            rows = staged[name]
            path = f"{target_path.rstrip('/')}/{name}"
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(BUCKET).parquet(path))
            kept = {r[0] for r in rows.select(BUCKET).distinct().collect()}
            for b in set(touched[name]) - kept:    # a bucket whose rows were all deleted
                fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"{BUCKET}={b}"), True)
    return apply


def _first_version(spark: SparkSession, target_path: str, checkpoint: str, names: list[str]) -> int:
    """The version of batch 0: above every version there was when the stream
    first started, kept beside the checkpoint for restarts."""
    path = f"{checkpoint.rstrip('/')}-first-version"
    first = read_number(spark, path)
    if first is None:
        now = current_commit(spark, target_path)
        first = 1 + max([now[0] if now else -1, *(v for n in names for v, _p, _ok in _versions(spark, target_path, n))])
        write_number(spark, path, first)
    return first


def _versioned_apply(t, target_path: str, entity: str, first: int, keep_versions: int | None, step):
    """Apply a micro-batch by ``step(tables, batch) -> (new tables, outcomes,
    whether rows were deleted)`` and publish what it changes as one commit."""
    names = [entity, *reached_tables(entity)]

    def apply(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            apply_pinned(_pin(batch, batch_id), batch_id)

    def apply_pinned(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Start from the newest version written by an earlier batch; a
        # retried batch ignores its own partial or complete output.
        version = first + batch_id
        cur = overlay(t)
        for name in names:
            prev = latest_version(target_path, name, spark, below=version)
            if prev is not None:
                cur[name] = spark.read.schema(S.TABLES[name]).parquet(prev)
        new, outcomes, deleted = step(cur, batch)
        changed = {n: new[n] for n in (names if deleted else [entity]) if n in cur}
        publish(spark, target_path, {outcome_table(entity): outcomes, **changed}, version=version, number=version)
        if keep_versions:
            for name in changed:
                drop_old_versions(spark, target_path, name, keep_versions)
    return apply


def replay_change_stream(changes: DataFrame, t: dict, target_path: str, checkpoint: str, as_of,
                         entity: str = "customers", trigger: dict | None = None, keep_versions: int | None = None):
    """Apply a stream of changes one by one: micro-batches as they arrive,
    the changes of a micro-batch by ``seq`` (see ``replay_changes``), which is
    the order in which a server would take the requests. Unique keys are
    freed and claimed in that order over the whole table. Each batch
    publishes the entity, the tables its deletes reach and an outcome for
    each change as one commit; a retried batch publishes the same again. No
    state is kept between batches but the tables. For feeds whose changes
    arrive late, out of order, use ``apply_change_stream``: there the
    sequence decides. Returns the started query."""
    spark = changes.sparkSession
    first = _first_version(spark, target_path, checkpoint, [entity, *reached_tables(entity), outcome_table(entity)])

    def step(cur, batch):
        new, outcomes = replay_changes(cur, batch, entity, as_of, written=True)    # by _pin
        return new, outcomes, bool(outcomes.where("outcome = 'deleted'").take(1))

    writer = (changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
              .foreachBatch(_versioned_apply(t, target_path, entity, first, keep_versions, step)))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def apply_change_stream(changes: DataFrame, t: dict, target_path: str, checkpoint: str,
                        as_of, entity: str = "customers", trigger: dict | None = None,
                        buckets: int | None = None, keep_versions: int | None = None):
    """Run the fold and apply each micro-batch to ``entity`` and the tables
    its deletes reach. A table of the previous batch is read back from
    ``target_path``; where there is none yet, ``t`` has it. Each batch also
    writes (id, outcome) as a version of ``outcome_table(entity)``. With
    ``buckets`` the bucketed layout is used (read it with ``read_bucketed``);
    a table that no delete reached is not written. ``keep_versions`` deletes
    all but so many complete versions of the tables after each batch (at
    least 2; outcomes stay). Returns the started query."""
    spark = changes.sparkSession
    names = [entity, *reached_tables(entity)]
    first = _first_version(spark, target_path, checkpoint, [*names, outcome_table(entity)])

    apply = _versioned_apply(t, target_path, entity, first, keep_versions, lambda cur, batch: (
        *apply_folded(cur, batch, entity, as_of), bool(batch.where("deleted").take(1))))
    if buckets:
        apply = _bucketed_apply(t, target_path, entity, as_of, buckets, first)
    writer = (fold_stream(changes, entity).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint).foreachBatch(apply))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
