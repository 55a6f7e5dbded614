"""Dense surrogate ids (SERIAL) for a batch, without a global window.

The batch is range-partitioned on its (unique) order key and sorted within
each partition; ``monotonically_increasing_id`` then holds the partition
index in its upper bits and the position in the partition in its lower 33
bits. The per-partition row counts (one number per partition, bounded by
the partition count, not the data) give each partition its offset. The numbered batch is first written as a table under the shared
checkpoint folder (one job), which cuts the lineage: a recomputation after
a lost executor reads the same rows and positions, so ids never change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.session import scratch_dir

POS_BITS = 33


def _cols(order_by) -> list[Column]:
    items = order_by if isinstance(order_by, (list, tuple)) else [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in items]


def largest_id(table: DataFrame, id_col: str = "id") -> int:
    """The largest id of ``table`` (0 when empty): one scalar to the driver."""
    row = table.agg(F.max(id_col).alias("m")).first()
    return int(row["m"] or 0)


# (table_name, last_id): the last id issued in each table, as ``load_tables``
# reads it from the table versions.
ID_SEQUENCES = "id_sequences"


def next_id(t, entity: str) -> int:
    """The last id issued in table ``entity``; new ids follow it. It comes
    from the sequences kept with the table versions, so the id of a deleted
    row is not issued again and the table is not read. Tables without a
    sequence (plain DataFrames) fall back to their largest id."""
    if ID_SEQUENCES in t:
        row = t[ID_SEQUENCES].where(F.col("table_name") == entity).select("last_id").first()
        if row is not None:
            return int(row["last_id"])
    return largest_id(t[entity])


def assign_ids(rows: DataFrame, start: int, order_by, id_col: str = "id",
               partitions: int | None = None) -> DataFrame:
    """Number ``rows`` ``start + 1, start + 2, ...`` in the order of
    ``order_by``, which must be unique (end it with a request key).

    Equal to ``start + row_number() OVER (ORDER BY order_by)`` at every size:
    the sort is a range shuffle, the numbering is per partition, and only the
    partition counts are combined in one place. AQE merges the partitions of
    a small batch; ``partitions`` fixes their number instead. Runs one write
    and one count when called.
    """
    spark = rows.sparkSession
    keys = _cols(order_by)
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id())
    path = scratch_dir(spark, "ids")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    mask = (1 << POS_BITS) - 1
    ranged = (ranged.withColumn("__part", F.shiftright("__mid", POS_BITS))
                    .withColumn("__pos", F.col("__mid").bitwiseAND(F.lit(mask))))
    # One count per partition (as RDD.zipWithIndex does): the driver sees
    # as many numbers as there are partitions, never the rows.
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, total = [], 0
    for row in sorted(counts, key=lambda r: r["__part"]):
        offsets.append((row["__part"], total))
        total += row["n"]
    off = spark.createDataFrame(offsets, "__part bigint, __off bigint")
    out = ranged.join(F.broadcast(off), "__part")
    new_id = (F.lit(int(start)) + F.col("__off") + F.col("__pos") + F.lit(1)).cast("bigint")
    return out.withColumn(id_col, new_id).drop("__mid", "__part", "__pos", "__off")
