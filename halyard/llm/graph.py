"""Connected components of a large graph, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import pin


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs with m: the least neighbour of u, u itself included."""
    least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (x, y): root is the smallest
    node it is connected with.

    Alternating large-star and small-star steps: every node passes its larger,
    then its smaller neighbours on to the smallest it knows, until the edges
    are stars around the roots; the number of rounds grows with the logarithm
    of the graph. Each round is two aggregations and two joins, written under
    the checkpoint folder; only a count and a checksum reach the driver. A
    node with very many neighbours is one row per task in the aggregation and
    a skewed key that Spark splits in the join.
    """
    now = pin(edges.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(),
              "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state["n"], state["x"]) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = (state["n"], state["x"])
        if not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _nearest(large)  # here every v is below its u
        now = pin(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (node, root) after joining the classes that ``more`` (x, y)
    connects; nodes of ``more`` without a label are their own root."""
    root = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    e = more.join(root("x"), "x", "left").join(root("y"), "y", "left")
    e = e.select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
    up = components(e).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = up.select(F.col("root").alias("node"), F.col("top").alias("root"))
    return moved.unionByName(new.join(labels, "node", "left_anti")).distinct()
