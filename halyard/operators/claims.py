"""Unique keys claimed and released in order, replayed by stretches of time.

A unique key that changes hands within a batch ties the changes of different
rows together: a claim stands if nobody else holds the key at that moment,
and who holds it depends on which earlier claims stood. ``resolve_claims``
finds for every claim what a row-by-row replay would. The events are cut by
sequence into segments of bounded size, so that one id or one key with a
third of all events is spread over many tasks; each task replays its segment
from who holds what at its start.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.session import pinned, scratch_dir

HOLD, CLAIM, FREE = "hold", "claim", "free"
# What a replay adds to its events: the key a row has after the segment.
AFTER = "after"
# Events of a segment, about: what one task replays in memory.
SEGMENT_ROWS = 100_000

_REPLAYED = "seg int, id bigint, seq bigint, key string, kind string, stands boolean"


def _replay():
    """The function that replays one segment: its claims and frees one after
    the other, from the keys held at its start (``hold``), each with whether
    it stands, and for each id whose key is another one at the end that key
    (``after``). Made here, it travels to the tasks as a whole."""
    def run(events: pa.Table) -> pa.Table:
        held = events.filter(pc.equal(events["kind"], HOLD))
        moves = events.filter(pc.not_equal(events["kind"], HOLD)).sort_by([("seq", "ascending"), ("id", "ascending")])
        began = dict(zip(held["id"].to_pylist(), held["key"].to_pylist()))
        has, holders, stands = dict(began), Counter(began.values()), []
        frees = pc.equal(moves["kind"], FREE).to_pylist()
        for id_, key, free in zip(moves["id"].to_pylist(), moves["key"].to_pylist(), frees):
            own = has.get(id_)
            stood = free or own == key or not holders[key]
            if stood and own is not None:
                holders[own] -= 1
            if stood:
                has[id_] = key    # a free has none
                holders[key] += not free
            stands.append(stood)
        after = [(id_, key) for id_, key in has.items() if key != began.get(id_)]
        n = len(after)
        ends = pa.table({"seg": [events["seg"][0].as_py()] * n, "id": [id_ for id_, _ in after], "seq": [0] * n,
                         "key": [key for _, key in after], "kind": [AFTER] * n}, schema=moves.schema)
        return pa.concat_tables([moves, ends]).append_column("stands", pa.array(stands + [True] * n, pa.bool_()))
    return run


def _at_start(holds: DataFrame, after: DataFrame, ids: DataFrame, keys: DataFrame, state: DataFrame) -> DataFrame:
    """(seg, id, key, now, was): who holds what at the start of each segment,
    of the ids and the keys that it touches (``ids``, ``keys``). ``now``: if
    before it each id had its key of ``holds`` and ``after`` each segment the
    one given there; ``was``: in ``state``, what this gave the last time."""
    spans = holds.select("id", "key", F.lit(-1).alias("since")).unionByName(after.select("id", "key", F.col("seg").alias("since")))
    spans = spans.withColumn("until", F.lead("since").over(Window.partitionBy("id").orderBy("since"))).where(F.col("key").isNotNull())
    within = (F.col("since") < F.col("seg")) & (F.col("until").isNull() | (F.col("seg") <= F.col("until")))
    found = [spans.join(touched, by).where(within).select("seg", "id", "key", F.lit(True).alias("now")) for touched, by in ((ids, "id"), (keys, "key"))]
    before = state.where("now").select("seg", "id", "key", F.lit(False).alias("now"))
    return found[0].unionByName(found[1]).unionByName(before).groupBy("seg", "id", "key").agg(
        F.bool_or("now").alias("now"), F.bool_or(~F.col("now")).alias("was"))


def resolve_claims(events: DataFrame) -> DataFrame:
    """``(seq, stands)`` for the claims among ``events`` (id, seq, key, kind).

    ``hold``: the row ``id`` has ``key`` before the batch (seq is ignored; a
    key has one holder). ``claim``: at ``seq`` the row asks for ``key``; if it
    gets it, it gives up the one it had. ``free``: at ``seq`` the row is
    gone. Claims and frees have distinct sequences, and no event of a row
    follows its free. A claim stands unless another row holds the key then.

    Keys that only one row touches are granted at once. The others are cut
    into segments by sequence. The first round replays each segment as if
    nothing had changed before it; each further round replays those for which
    the segments before them, as last replayed, leave another state, until
    there are none. After n rounds the first n segments are right, so there
    are as many rounds as segments at most, however many refusals follow from
    each other. Every round is written under the checkpoint folder; only
    numbers of segments reach the driver."""
    e = pinned(events.select(F.col("id").cast("bigint").alias("id"), F.col("seq").cast("bigint").alias("seq"), "key", "kind"), "claims")
    contested = (e.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"))
                 .where("a <> b").select("key"))
    ids = e.join(contested, "key", "left_semi").select("id").distinct().withColumn("live", F.lit(True))
    e = pinned(e.join(ids, "id", "left"), "claims-live")
    claims, moved = F.col("kind") == CLAIM, F.col("kind") != HOLD
    n = -(-e.where(F.col("live") & moved).count() // SEGMENT_ROWS)
    if not n:
        return e.where(claims).select("seq", F.lit(True).alias("stands"))
    moves = pinned(e.where(F.col("live") & moved).drop("live").repartitionByRange(n, "seq")
                   .withColumn("seg", F.spark_partition_id()), "claims-moves")
    holds = pinned(e.where(F.col("live") & ~moved).select("id", "key").distinct(), "claims-holds")
    known = _rounds(moves, holds, n).where(claims).select("seq", "stands")
    rest = e.where(claims & F.col("live").isNull()).select("seq", F.lit(True).alias("stands"))
    return known.unionByName(rest)


def _rounds(moves: DataFrame, holds: DataFrame, n: int) -> DataFrame:
    """``moves`` (id, seq, key, kind, seg; ``n`` segments) as replayed in the
    last round that each segment takes part in."""
    spark, todo = moves.sparkSession, list(range(n))
    touched = pinned(reduce(DataFrame.unionByName, [
        moves.where(F.col(c).isNotNull()).select("seg", c).distinct().select("seg", *[
            F.col(x) if x == c else F.lit(None).cast(moves.schema[x].dataType).alias(x) for x in ("id", "key")])
        for c in ("id", "key")]), "claims-touched")
    ids, keys = (touched.where(F.col(c).isNotNull()).select("seg", c) for c in ("id", "key"))
    after = holds.limit(0).withColumn("seg", F.lit(0))
    start, latest = after.withColumn("now", F.lit(True)), {}
    for k in range(n):
        start = pinned(_at_start(holds, after, ids, keys, start), "claims-start")
        if k:
            todo = [r["seg"] for r in start.where("now <> was").select("seg").distinct().collect()]
        if not todo:
            break
        path, stale = scratch_dir(spark, "claims-round"), F.col("seg").isin(todo)
        held = start.where(stale & F.col("now")).select("seg", "id", F.lit(0).cast("bigint").alias("seq"), "key", F.lit(HOLD).alias("kind"))
        (moves.where(stale).select(*held.columns).unionByName(held).repartition(2 * len(todo), "seg")
         .groupBy("seg").applyInArrow(_replay(), _REPLAYED).withColumn("of", F.col("seg")).write.partitionBy("of").parquet(path))
        latest.update(dict.fromkeys(todo, path))
        # Of each round, the segments that were not replayed again since.
        replayed = reduce(DataFrame.unionByName, [
            spark.read.schema(f"{_REPLAYED}, of int").parquet(p).where(F.col("of").isin([seg for seg in latest if latest[seg] == p]))
            for p in dict.fromkeys(latest.values())]).drop("of")
        after = replayed.where(F.col("kind") == AFTER)
    return replayed
