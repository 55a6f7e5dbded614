"""F3 through an index of trigrams: substring search that reads the postings
of a term's rarest trigrams instead of every customer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.joins import small_side
from halyard.operators.views import filter_customers

SEARCHED = ["first_name", "last_name", "email"]
GRAM = 3
# Rarest trigrams of a term whose postings are intersected, at most; what is
# left is checked on the texts.
INTERSECTED = 4
BUCKET = "gram_bucket"


def gram_bucket(buckets: int, gram: str | Column = "gram") -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _grams(text: Column) -> Column:
    low = F.lower(text)
    last = F.length(low) - (GRAM - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(low, i, F.lit(GRAM)))) \
        .otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, columns: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """(gram, id): every trigram of the lower-case texts, once a row. NULL
    and shorter texts have none. One projection: no row meets another."""
    grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(F.col(c)), F.array().cast("array<string>"))
                                                  for c in columns or SEARCHED])))
    return rows.select(F.explode(grams).alias("gram"), F.col(id_col).alias("id"))


def write_postings(index: DataFrame, path: str, buckets: int = 64) -> None:
    """The index in folders by a hash of the trigram, sorted by trigram in
    each file, so that a search reads a few folders and there the row groups
    of its trigrams."""
    (index.withColumn(BUCKET, gram_bucket(buckets)).repartition(BUCKET).sortWithinPartitions("gram", "id")
     .write.mode("overwrite").partitionBy(BUCKET).parquet(path))


def read_postings(spark: SparkSession, path: str, grams: list[str], buckets: int = 64) -> DataFrame:
    """The postings of ``grams``: a filter on folders and on trigrams."""
    wanted = reduce(lambda a, b: a | b, [F.col(BUCKET) == gram_bucket(buckets, F.lit(g)) for g in grams])
    return spark.read.parquet(path).where(wanted & F.col("gram").isin(grams)).drop(BUCKET)


def term_grams(term: str) -> list[str] | None:
    """The distinct trigrams that every match of ``term`` holds; None for a
    term with wildcards or escapes, or of fewer letters, which only a scan
    answers."""
    if any(c in term for c in "%_\\"):
        return None
    low = term.lower()
    grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    return grams or None


def indexed_search(customers: DataFrame, index, term: str, small: bool | None = None) -> DataFrame:
    """``customers`` whose names or e-mail hold ``term`` in any case: the rows
    of ``filter_customers(search=term)``. ``index`` is a postings table, or a
    function from a list of trigrams to their postings (``read_postings``).

    The term's trigrams are counted in the index (one small row each); the
    postings of the rarest are intersected, those customers are looked up, and
    the term is checked on their texts. Terms that the index can't answer go
    by scan, and a trigram that no text has ends the search."""
    grams = term_grams(term)
    if not term or grams is None:
        return filter_customers(customers, search=term)
    found = index(grams) if callable(index) else index.where(F.col("gram").isin(grams))
    counts = {r["gram"]: r["n"] for r in found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < len(grams):
        return customers.limit(0)
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:INTERSECTED]
    ids = (found.where(F.col("gram").isin(rarest)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") == len(rarest)).select("id"))
    small = counts[rarest[0]] <= 1_000_000 if small is None else small
    return filter_customers(customers.join(small_side(ids, small=small), "id", "left_semi"), search=term)
