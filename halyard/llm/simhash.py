"""Near duplicates by SimHash fingerprints, found through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import pin, runs
from halyard.llm.graph import components

SEED = 42
# Fingerprints that fit the upper tree's splits on the driver, at most. They
# place the splits only: every fingerprint is dealt and compared.
SAMPLE = 20_000
# Fingerprints a shard should hold, about, and shards at most.
SHARD, MAX_SHARDS = 32_768, 4_096
# Fingerprints of one shard, as points or as queries, that a task holds at most, about.
CELL = 65_536
# Points under which a task's own tree compares instead of splitting.
BUCKET = 256
# Shingles hashed at a time.
CHUNK = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(data: bytes, width: int = 4) -> int:
    """The 64-bit SimHash of UTF-8 ``data``: bit k is 1 if over half of the
    XXH64 of its ``width``-word shingles (repeats included, A-Z in lower case,
    words joined by one space) have it; 0 without words."""
    words = data.translate(_LOWER).split()
    if not words:
        return 0
    joined, total = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:total].tolist()
    ends = ends[-total:].tolist()
    counts, digest = np.zeros((8, 8), dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])],
                     dtype="<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(h[:, k], minlength=256) @ _BITS
    return sum(1 << k for k, c in enumerate(counts.ravel().tolist()) if 2 * c > total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): a row for each row of ``docs``; fp is the signed long
    with the fingerprint's bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width)
                   for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


def distances(points: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(points ^ to)


@dataclass
class Node:
    """A vantage point: fingerprints at most ``radius`` from it go inside."""
    point: np.uint64
    radius: int
    inside: "Node | int"
    outside: "Node | int"


def _split(points: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point (of 16 tried) and radius whose boundary zone, the
    shell that queries must cross, holds the fewest points for its balance."""
    best = None
    for v in rng.choice(points, min(16, len(points)), replace=False):
        below = np.cumsum(np.bincount(distances(points, v), minlength=65))
        for r in np.flatnonzero((4 * below >= len(points)) & (4 * below <= 3 * len(points))):
            zone = below[min(64, r + reach)] - (below[r - reach] if r >= reach else 0)
            cost = zone + abs(2 * below[r] - len(points)) / 2
            if best is None or cost < best[0]:
                best = (cost, v, int(r))
    return best[1:] if best else None


def vantage_tree(points: np.ndarray, shards: int, reach: int) -> tuple[Node | int, int]:
    """(tree, number of its shards): the points split by their distance to
    vantage points, largest part first, into about ``shards`` parts. The same
    points give the same tree."""
    rng, parts, splits = np.random.default_rng(7), [np.sort(points)], {}
    open_ = {0}
    while open_ and len(parts) - len(splits) < shards:
        k = max(open_, key=lambda i: (len(parts[i]), -i))
        open_.remove(k)
        if len(parts[k]) < 2 or (found := _split(parts[k], reach, rng)) is None:
            continue
        near = distances(parts[k], found[0]) <= found[1]
        splits[k] = (*found, len(parts), len(parts) + 1)
        open_ |= {len(parts), len(parts) + 1}
        parts += [parts[k][near], parts[k][~near]]
    leaf = {k: i for i, k in enumerate(k for k in range(len(parts)) if k not in splits)}
    nodes: dict[int, Node | int] = dict(leaf)
    for k in sorted(splits, reverse=True):
        v, r, a, b = splits[k]
        nodes[k] = Node(v, r, nodes[a], nodes[b])
    return nodes[0], len(leaf)


def visits(tree: Node | int, fps: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, indices, whether it is their own) for every shard that holds
    fingerprints within ``reach`` of those of ``fps``, by the triangle bound.

    Of two that a split parts, only the one outside looks inside; so each
    pair meets in the shard of one of them.
    """
    todo = [(tree, np.arange(len(fps)), True)]
    while todo:
        node, at, own = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at, own
            continue
        d = distances(fps[at], node.point).astype(np.int64)
        near = d <= node.radius
        if own:
            todo += [(node.inside, at[near], True), (node.outside, at[~near], True),
                     (node.inside, at[~near & (d <= node.radius + reach)], False)]
        else:
            todo += [(node.inside, at[d <= node.radius + reach], False), (node.outside, at[d > node.radius - reach], False)]


def _local_pairs(points: np.ndarray, at: np.ndarray, asked: np.ndarray, who: np.ndarray, reach: int,
                 rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into ``points``, into ``asked``) within ``reach``: a
    vantage-point tree over the points, walked by all queries at once."""
    todo = [(at, who)]
    while todo:
        at, who = todo.pop()
        if not len(at) or not len(who):
            continue
        found = _split(points[at], reach, rng) if len(at) > BUCKET else None
        if found is None:
            step = max(1, (1 << 22) // len(at))
            for k in range(0, len(who), step):
                q = who[k:k + step]
                i, j = np.nonzero(np.bitwise_count(asked[q][:, None] ^ points[at][None, :]) <= reach)
                yield at[j], q[i]
            continue
        v, r = found
        near = distances(points[at], v) <= r
        d = distances(asked[who], v).astype(np.int64)
        todo += [(at[near], who[d <= r + reach]), (at[~near], who[d > r - reach])]


def spanning_links(points: np.ndarray, asked: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of values within ``reach``, one of each side, as few as connect
    all that such pairs connect."""
    values, code = np.unique(np.concatenate([points, asked]), return_inverse=True)
    a, b = code[:len(points)], code[len(points):]
    label, xs, ys = np.arange(len(values)), [], []
    for i, j in _local_pairs(points, np.arange(len(points)), asked, np.arange(len(asked)), reach, np.random.default_rng(11)):
        x, y = a[i], b[j]
        while True:  # hook the larger label under the least it meets, then flatten
            lx, ly = label[x], label[y]
            differ = lx != ly
            if not differ.any():
                break
            x, y, lx, ly = x[differ], y[differ], lx[differ], ly[differ]
            high, first = np.unique(np.maximum(lx, ly), return_index=True)
            xs.append(x[first])
            ys.append(y[first])
            label[high] = np.minimum(lx, ly)[first]
            while not np.array_equal(flat := label[label], label):
                label = flat
    none = np.empty(0, dtype=np.int64)
    return values[np.concatenate([none, *xs]).astype(int)], values[np.concatenate([none, *ys]).astype(int)]


def fingerprint_links(nodes: DataFrame, reach: int = 4, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """(x, y): links that connect what pairs of ``nodes`` (fp, distinct) with
    at most ``reach`` differing bits connect.

    1. An upper tree from at most ``SAMPLE`` fingerprints (those of least
       hash) cuts the space into shards by distance.
    2. Each fingerprint goes to its own shard, as point and query, and as a
       query to the shards that its ball overlaps; the triangle bound rules
       out the others.
    3. Shards of more than ``cell`` points or queries are cut into cells that
       pair a block of each, so no task holds more. A task walks a tree of
       its own over the points with all its queries, confirms by the whole
       fingerprints and hands on a spanning forest, never all pairs.
    """
    n = nodes.count()
    sample = [r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    tree, _ = vantage_tree(np.array(sample, dtype=np.int64).view(np.uint64), min(MAX_SHARDS, -(-n // shard)), reach)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy()
            for k, at, own in visits(tree, fps.view(np.uint64), reach):
                yield pd.DataFrame({"shard": k, "fp": fps[at], "own": own})

    dealt = pin(nodes.mapInPandas(deal, "shard int, fp long, own boolean"), "simhash-visits")
    size = dealt.groupBy("shard").agg(F.ceil(F.sum(F.col("own").cast("long")) / cell).cast("int").alias("np"),
                                      F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("nq"))
    # As many rows as the tree has shards, MAX_SHARDS at most.
    rows = dealt.join(F.broadcast(size), "shard")
    hashed = lambda n_: F.pmod(F.xxhash64("fp"), F.greatest(F.col(n_), F.lit(1))).cast("int")
    every = lambda n_: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n_), F.lit(1)) - 1))
    asked = rows.filter("np > 0").select("shard", every("np").alias("p"), hashed("nq").alias("q"), F.lit(False).alias("point"), "fp")
    points = rows.filter("own").select("shard", hashed("np").alias("p"), every("nq").alias("q"), F.lit(True).alias("point"), "fp")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["shard", "p", "q"]):
            fps, point = pdf["fp"].to_numpy().view(np.uint64), pdf["point"].to_numpy()
            x, y = spanning_links(fps[point], fps[~point], reach)
            yield pd.DataFrame({"x": x.view(np.int64), "y": y.view(np.int64)})

    cells = asked.unionByName(points).repartition("shard", "p", "q").sortWithinPartitions("shard", "p", "q")
    return cells.mapInPandas(link, "x long, y long")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                       reach: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id reachable over pairs of fingerprints
    with at most ``reach`` differing bits).

    Rows of one fingerprint are one node, whatever their number, so copies
    are never paired. Defined results: null, empty or word-less texts have
    fingerprint zero and are linked like any other; a text of fewer words
    than ``width`` is one shingle; rows with a null or a repeated id are rows
    like others (null is no smallest id; a component of null ids only has a
    null component_id); an empty table gives an empty table; other columns
    are ignored.
    """
    rows = pin(fingerprints(docs, id_col, text_col, width), "simhash-fingerprints")
    nodes = pin(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    label = pin(components(fingerprint_links(nodes.select("fp"), reach)), "simhash-components")
    rooted = nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
