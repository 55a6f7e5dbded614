"""Byte-balanced shards by histogram sort: exact counts below probed key
boundaries, refined until the splitters are good, then one exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import pin, text_or_empty, unit_key

# A key is 52 bits from the id, then some from the row's number, so that rows
# with one id, or none, can be cut apart.
ID_BITS, ROW_BITS = 52, 10
KEY_BITS = ID_BITS + ROW_BITS
# Each round splits the interval of a splitter into 2 ** STEP_BITS probes.
STEP_BITS = 8
# Rows numbered by one task, about, and the most parts of a shard.
PART_ROWS = 100_000
MAX_PARTS = 64


def histogram_splitters(rows: DataFrame, n: int, tolerance: float = 0.0, key_bits: int = KEY_BITS) -> list[int]:
    """n - 1 key boundaries that cut ``rows`` (key, size) into n ranges of
    near equal size; range k holds the keys from boundary k - 1 on.

    Keys are in [0, 2 ** key_bits). Each round counts, in one aggregation over
    all rows still in question, the exact size below every probe: the edges of
    2 ** STEP_BITS equal parts of each open interval. A splitter is done when
    an edge lies within ``tolerance`` of a range's size from its target, or
    when one key value alone is left, of which the nearer side is taken. The
    driver sees at most (n - 1) * 2 ** STEP_BITS sums a round, whatever the
    input. Rows that tie in the key stay together.
    """
    done: dict[int, int] = {}
    open_ = {k: (0, 0) for k in range(1, n)}  # splitter -> (prefix of its interval, size below it)
    bits, total = 0, None
    while open_:
        step = min(STEP_BITS, key_bits - bits)
        asked = rows if bits == 0 else rows.filter(
            F.shiftright("key", key_bits - bits).isin(sorted({p for p, _ in open_.values()})))
        bits += step
        got = sorted(tuple(r) for r in asked.groupBy(F.shiftright("key", key_bits - bits).alias("part")).agg(
            F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect())
        if total is None:
            total = sum(r[1] for r in got)
            if not got:
                return []
        held: dict[int, list] = {}
        for r in got:
            held.setdefault(r[0] >> step, []).append(r)
        still = {}
        for k, (prefix, below) in open_.items():
            for part, size, low, high in held[prefix]:
                # all times n, so that the target k * total / n is an integer
                start, end, target, slack = below * n, (below + size) * n, k * total, tolerance * total
                if target >= end and (part, size, low, high) != held[prefix][-1]:
                    below += size
                    continue
                first, past = part << (key_bits - bits), (part + 1) << (key_bits - bits)
                if low == high or min(target - start, abs(end - target)) <= slack:
                    done[k] = first if 2 * target <= start + end else past
                    if low == high:
                        done[k] = low if 2 * target <= start + end else low + 1
                else:
                    still[k] = (part, below)
                break
        open_ = still
    return [done[k] for k in range(1, n)]


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   tolerance: float = 0.0, overhead: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, key, shard, slot.

    ``size`` is the text's UTF-8 bytes plus ``overhead``. Rows are put in the
    order of a hash of their id (so a shard is a random mix of sources, and
    copies of a text are spread like any other rows), then of their number as
    read (so are rows that repeat an id or have none), and cut where the bytes
    before a row come nearest to an equal share. ``slot`` counts from 0 in a
    shard, without gaps. Large shards are numbered in several key ranges, made
    by the same splitters, whose row counts are then added up.

    Defined results: a null or empty text has the overhead alone; rows with a
    null or a repeated id are rows like others; an empty table gives an empty
    table.
    """
    text = text_or_empty(text_col)
    rows = pin(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("bigint").alias("size"),
                           F.crc32(text.cast("binary")).alias("text_crc32"),
                           (F.shiftleft(unit_key(F.col(id_col), seed="shard"), ROW_BITS)
                            + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))).alias("key")),
               "shard-rows")
    parts = max(1, min(MAX_PARTS, -(-rows.count() // (n_shards * PART_ROWS))))
    cuts = histogram_splitters(rows.select("key", "size"), n_shards * parts, tolerance)
    main = cuts[parts - 1::parts]
    shard = sum([(F.col("key") >= c).cast("int") for c in main], F.lit(0))
    rows = rows.withColumn("shard", shard)
    part = F.lit(0)
    if parts > 1 and cuts:
        within = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in cuts[s * parts:(s + 1) * parts - 1]])
                           for s in range(n_shards)])
        part = F.size(F.filter(within[F.col("shard")], lambda c: F.col("key") >= c))
    rows = rows.withColumn("part", part)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    order = Window.partitionBy("shard", "part").orderBy("key", "doc_id", "text_crc32", "size")
    # At most n_shards * MAX_PARTS offsets: bounded whatever the input.
    out = rows.withColumn("n", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "key", "shard", (F.col("first") + F.col("n") - 1).alias("slot"))
