"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import WORD, fresh, numbered, pin, small, text_or_empty, unit_key

MAX_COPIES = 3
# About as many rows fall into each bin of ranks.
BIN_ROWS = 50_000


def by_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on source, where null equals null."""
    b = b.withColumnRenamed("source", "other_source")
    return a.join(b, F.col("source").eqNullSafe(F.col("other_source")), how).drop("other_source")


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, weight): sources by code point, null last, weigh 1..cycle,
    repeating. One row per source; the window is over those rows only."""
    by = Window.orderBy(F.col("source").isNull(), "source")
    return (sources.select("source").distinct()
            .select("source", ((F.row_number().over(by) - 1) % cycle + 1).cast("bigint").alias("weight")))


def targets(sizes: DataFrame, weights: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target): shares of the total size by weight.

    A target stops at ``max_copies`` times its source's size; what is over is
    shared again by weight among the others until none is above. In order of
    size per weight the capped sources come first, so running sums give the
    level at which sharing ends: one pass over one row per source.
    """
    cap = (F.col("source_size") * max_copies).alias("cap")
    t = by_source(sizes, weights).select("source", "source_size", "weight", cap)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
                 F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
                 F.sum("source_size").over(whole).alias("total"), F.sum("weight").over(whole).alias("weights"),
                 F.row_number().over(by).alias("rank"))
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")).cast("double")
    t = t.withColumn("level", level)
    t = t.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    t = t.withColumn("end", F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(whole))
    full = F.col("end").isNull() | (F.col("rank") < F.col("end")["rank"])
    return t.select("source", "source_size", F.when(full, F.col("cap").cast("double"))
                    .otherwise(F.col("end")["level"] * F.col("weight")).alias("target"))


def pareto_take(cands: DataFrame, budgets: DataFrame, bins: int) -> DataFrame:
    """``cands`` (source, q, doc_id, size, ...) with ``picked``: in order of
    the Pareto rank q, documents are taken while the source's ``budget`` words
    are not exceeded.

    The order of a hot source is never built in one task. Ranks fall into
    ``bins`` ranges; sums by (source, bin) give the bin in which the budget
    ends; only that bin's rows are ordered one by one.
    """
    binned = cands.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * bins).cast("int"))
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    over = F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))
    cut = small(pin(by_source(sums, budgets).groupBy("source").agg(
        F.min(F.when(F.col("upto") > F.col("budget"), over)).alias("cut"), F.first("budget").alias("budget")), "mix-cuts"))
    j = by_source(binned, cut)
    last = F.col("cut").isNotNull() & (F.col("bin") == F.col("cut")["bin"])
    sure = F.col("cut").isNull() | (F.col("bin") < F.col("cut")["bin"])
    by = Window.partitionBy("source").orderBy("q", "doc_id", "row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    edge = j.filter(last).withColumn("after", F.col("cut")["before"] + F.sum("size").over(by))
    return (j.filter(~last).select(*cands.columns, sure.alias("picked"))
            .unionByName(edge.select(*cands.columns, (F.col("after") <= F.col("budget")).alias("picked"))))


def pareto_fill(cands: DataFrame, budgets: DataFrame, bins: int) -> DataFrame:
    """``cands`` with ``picked``: in order of the Pareto rank, every document
    is taken that fits into what is left of its source's budget; one that
    does not fit is passed over.

    Each round takes what stands before the first document that does not fit
    (``pareto_take``), then goes on with those behind it that are no larger
    than what is still lacking, until no source has any. The budget left is
    less than one document after the first round, so rounds are few.
    """
    drawn = pin(pareto_take(cands, budgets, bins), "mix-drawn")
    left, lack, more = drawn.filter(~F.col("picked") & (F.col("size") > 0)).drop("picked"), budgets, drawn.filter("picked")
    rows = None
    while True:
        got = more.groupBy("source").agg(F.sum("size").alias("got"))
        lack = small(pin(by_source(lack, got, "left").select("source", (
            F.col("budget") - F.coalesce("got", F.lit(0))).alias("budget")), "mix-lacks"))
        left = pin(by_source(left, lack).filter(F.col("size") <= F.col("budget")).drop("budget"), "mix-left")
        if not left.take(1):
            break
        taken = pin(pareto_take(left, lack, bins), "mix-more")
        left, more = taken.filter(~F.col("picked")).drop("picked"), taken.filter("picked")
        rows = more.select("row") if rows is None else rows.unionByName(more.select("row"))
    if rows is None:
        return drawn
    rows = pin(rows.withColumn("late", F.lit(True)), "mix-late")
    return drawn.join(rows, "row", "left").withColumn("picked", F.col("picked") | F.col("late").isNotNull()).drop("late")


def best_fits(drawn: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, row) of the document per source that, added to those picked,
    brings the source nearest to its budget, if any does."""
    got = drawn.groupBy("source").agg(F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0)).alias("got"))
    lack = small(pin(by_source(budgets, got).select(
        "source", (F.col("budget") - F.col("got")).alias("lack")), "mix-lacks"))
    off = F.abs(F.col("lack") - F.col("size"))
    fit = (by_source(drawn.filter(~F.col("picked")), lack).filter(off < F.abs(F.col("lack")))
           .groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", "doc_id", "row")).alias("fit")))
    return fit.select("source", F.col("fit")["row"].alias("row"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", max_copies: int = MAX_COPIES,
                seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    copies, taken.

    ``size`` counts words. Each source's target share r = target / source_size
    gives every document floor(r) certain copies. The rest, (r - floor(r)) of
    the source's words, is drawn by Pareto order sampling: with u uniform and
    p = r - floor(r), documents are ranked by (u / (1 - u)) / (p / (1 - p)) and
    taken in that order; one that does not fit into the words still wanted is
    passed over. If a document larger than what is then lacking brings the
    source nearer to its target, the nearest is added. ``weights`` is (source, weight), one row per
    source; by default 1, 2, 3, repeating. u is a hash of seed and id, so
    reruns agree; rows without an id go by their number, so that they do not
    all have one rank. With ``row_col``, a unique number of each row, the
    result has it too, as ``row``.

    Defined results: a null source is a source; a null or empty text has size
    0 and takes nothing; documents tied in rank go by id; repeated rows are
    documents of their own; an empty table gives an empty table.
    """
    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint").alias("size"),
                       unit_key(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), number.cast("string"))),
                                seed=seed).alias("k"), number.alias("row"))
    base = pin(base, "mix-rows")
    bins = max(64, min(1 << 20, base.count() // BIN_ROWS))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, cycled_weights(sizes) if weights is None else weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.least(F.floor(ratio), F.lit(max_copies)).cast("bigint"))
    plan = plan.withColumn("p", ratio - F.col("whole"))
    plan = small(pin(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan"))
    budgets = plan.select("source", "budget")
    u = (F.col("k") + 0.5) / float(1 << 52)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rows = by_source(base, plan).withColumn("q", F.when(F.col("p") > 0, q)).drop("budget", "k")
    drawn = pareto_fill(rows.filter("q is not null"), budgets, bins)
    drawn = pin(drawn.unionByName(rows.filter("q is null").withColumn("picked", F.lit(False))), "mix-picked")
    fits = small(pin(best_fits(drawn.filter("q is not null"), budgets).select("row", F.lit(True).alias("fit")), "mix-fits"))
    out = drawn.join(fits, "row", "left")
    copies = F.col("whole") + (F.col("picked") | F.col("fit").isNotNull()).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"), *([] if row_col is None else ["row"]))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken (rows
    taken 0 times go), all columns kept. Rows are numbered and found again by
    number, so null and repeated ids are copied as the mix says, too."""
    copy = fresh(docs, "mix_copy")
    rows, row = numbered(docs, id_col)
    mix = mix_sources(rows, id_col=id_col, row_col=row, **options).filter("copies > 0").select(
        F.col("row").alias("mix_row"), F.col("copies").cast("int").alias("mix_copies"))
    one = rows.join(mix, rows[row] == mix["mix_row"]).select(*[rows[c] for c in docs.columns], mix["mix_copies"].alias(copy))
    return one.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).drop(copy)
