"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read
again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halyard.llm.common import numbered, pin
from halyard.llm.exact_dedup import drop_exact_duplicates
from halyard.llm.mixing import mixed_documents
from halyard.llm.near_dup import drop_near_duplicates
from halyard.llm.packing import pack_documents
from halyard.llm.quality import keep_good
from halyard.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, of the smallest doc_id (null last)."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares 80 % of its five-word shingles."""
    rows, row = numbered(docs)
    return drop_near_duplicates(rows, id_col=row, width=5, percent=80).drop(row)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows as often as the mix takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents (copies are packed each) in sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mix", mix), ("pack", pack)]

# The near-duplicate and packing stages are iterative; tests/llm compares the
# rows of run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = pin(docs, f"pipeline-{name}")
    return docs
