"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.session import scratch_dir

# A word is a maximal run of characters outside this white space. It is also
# exactly what ``bytes.split()`` splits on, so Python tasks agree with SQL.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# A table of at most this many rows of a few scalars may be broadcast.
BROADCAST_ROWS = 10_000


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: a task repeated after the loss of an executor
    reads the same rows. The tables stay until that folder is cleaned.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df`` (a pinned table of scalars) with a broadcast hint, if its
    counted rows stay under ``BROADCAST_ROWS``; else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any letter case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs``, written once with a unique number for each row, and the
    number's column name. Numbers follow the id, nulls last; rows that tie
    follow each other as read, so no id, however frequent, is one partition."""
    row, read = fresh(docs, "row_number"), fresh(docs, "row_read")
    order = [F.col(id_col).isNull(), F.col(id_col), F.col(read)]
    dealt = docs.withColumn(read, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return pin(dealt.withColumn(row, F.monotonically_increasing_id()).drop(read), "numbered-rows"), row


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unit_key(*cols: Column, seed: str = "") -> Column:
    """A reproducible 52-bit number from the values (MD5, so that any SQL
    engine can repeat it); divide by 2**52 for a uniform in [0, 1)."""
    joined = F.concat_ws("/", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint")


def runs(batches: Iterable[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Cut batches that are sorted by ``key`` into one frame per key value.

    Holds one group at a time. Nulls of a key column count as one value.
    """
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        codes = pdf[key].astype(object).where(pdf[key].notna(), None)
        rows = list(codes.itertuples(index=False, name=None))
        start = 0
        for i, value in enumerate(rows):
            if last is not None and value != last[0]:
                piece = held + ([pdf.iloc[start:i]] if i > start else [])
                yield pd.concat(piece, ignore_index=True) if len(piece) > 1 else piece[0].reset_index(drop=True)
                held, start = [], i
            last = (value,)
        held.append(pdf.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
