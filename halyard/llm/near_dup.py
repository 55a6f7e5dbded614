"""Near duplicates by MinHash with tensored banding; links are verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import fresh, pin, runs
from halyard.llm.graph import components, relabelled

# Minhash values of a set; a byte of each is kept to compare candidates with.
VALUES = 128
# How often, at most, a pair at the threshold may miss every table, or agree in
# too few bytes to be verified.
MISSED, SKIPPED = 1e-4, 1e-5
# Texts, and shingles, that one verification task holds of a family at most, about.
BLOCK_ROWS, BLOCK_SHINGLES = 500, 400_000
# Bytes of text hashed at a time.
CHUNK = 1 << 20

_U = np.uint64


class Banding(NamedTuple):
    """Two collections of ``bands`` hashes, each over ``rows`` minhash values.
    A table key is a pair, one from each: bands ** 2 tables from 2 * bands *
    rows minhash values. Two sets of similarity s meet in a table with
    probability (1 - (1 - s ** rows) ** bands) ** 2. Sets that agree in fewer
    than ``least_equal`` of VALUES bytes are not verified."""
    bands: int
    rows: int
    least_equal: int


@cache
def banding(percent: int) -> Banding:
    """The banding for a threshold: at 80, 10 bands of 2 rows, which pairs of
    0.8 miss with probability 7e-5 (and pairs of 0.1 meet in with 0.01)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    s, bands, rows = percent / 100, 1, 2 if percent >= 75 else 1
    while (1 - (1 - s ** rows) ** bands) ** 2 < 1 - MISSED:
        bands += 1
    if 2 * bands * rows > VALUES:
        raise ValueError(f"no banding of {VALUES} minhash values finds pairs of {percent} percent")
    below, k = (1 - s) ** VALUES, 0  # of agreeing in at most k values
    while below < SKIPPED:
        k += 1
        below += comb(VALUES, k) * s ** k * (1 - s) ** (VALUES - k)
    return Banding(bands, rows, k)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_BASE = 0x9E3779B97F4A7C15
_ODD = _scramble(np.arange(1, VALUES + 64, dtype=np.uint64)) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _scramble(np.arange(1000, 1256, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of UTF-8 ``data``, A-Z in lower case:
    a polynomial over the bytes, from differences of running sums."""
    size = max(CHUNK, 1 << (len(data)).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    up, down = _POWERS[size]
    raw = np.frombuffer(data, dtype=np.uint8)
    space = np.concatenate(([True], _SPACE[raw], [True]))
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, _scramble(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _long_words(data: bytes) -> np.ndarray:
    """The word hashes of one text of any length, CHUNK by CHUNK."""
    out, at = [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return words
    k = min(width, len(words))
    h = np.full(len(words) - k + 1, k, dtype=np.uint64)  # a short sequence differs from any full shingle
    for i in range(k):
        h = (h ^ (h >> _U(29))) * _ODD[VALUES + i % 16] + words[i:i + len(h)]
    return np.unique(_scramble(h))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its ``width``-word
    shingles. Words are the runs of WORD; with fewer than ``width`` words the
    whole sequence is the only shingle, without words there is none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < CHUNK):
            size += len(texts[end] or b"") + 1
            end += 1
        if end == at + 1:
            out.append(_shingles(_long_words(texts[at] or b""), width))
        else:
            part = [t or b"" for t in texts[at:end]]
            starts, words = word_hashes(b" ".join(part))
            cuts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))
            out.extend(_shingles(words[a:b], width) for a, b in zip(cuts, cuts[1:]))
        at = end
    return out


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """The VALUES minhash values of each non-empty set."""
    out = np.empty((len(sets), VALUES), dtype=np.uint64)
    at = 0
    while at < len(sets):  # some hundred thousand hashes at a time
        end, n = at + 1, len(sets[at])
        while end < len(sets) and n < 200_000:
            n += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(x) for x in sets[at:end - 1]])
        for k in range(VALUES):
            out[at:end, k] = np.minimum.reduceat(flat * _ODD[k], starts)  # an odd factor permutes the 64-bit numbers
        at = end
    return out


def _sketch(values: np.ndarray) -> np.ndarray:
    return (values >> _U(40)).astype(np.uint8)


def _half_keys(values: np.ndarray, band: Banding) -> np.ndarray:
    """The hashes of both collections, numbered by place."""
    used = values[:, :2 * band.bands * band.rows].reshape(len(values), 2 * band.bands, band.rows)
    key = np.broadcast_to(np.arange(2 * band.bands, dtype=np.uint64), used.shape[:2]) + _U(1)
    for i in range(band.rows):
        key = _scramble(key * _U(_BASE) + used[:, :, i])
    return key.view(np.int64)


SIGNATURE = "doc_id long, n long, digest binary, keys array<long>, sketch binary"


def _signatures(width: int, band: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, sketch = [None] * len(sets), [None] * len(sets)
                if full:
                    values = minhash([sets[i] for i in full])
                    for i, k, s in zip(full, _half_keys(values, band), _sketch(values)):
                        keys[i], sketch[i] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n", "digest", "keys", "sketch"])
    return run


class _Joined(dict):
    """A union-find over a task's few items."""

    def top(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def join(self, x, y) -> None:
        self[self.top(x)] = self.top(y)


def _alike(sketches: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` may be as similar to i as asked, by size and sketch."""
    small, large = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
    others = others[100 * small >= percent * large]
    return others[(sketches[others] == sketches[i]).sum(axis=1) >= banding(percent).least_equal]


def _spanning_links(side: np.ndarray, cls: list, sketches: np.ndarray, sizes: np.ndarray, percent: int,
                    confirm) -> Iterator[tuple[int, int]]:
    """Pairs of items of different classes that are alike and confirmed, as
    few as connect all that such pairs connect. Items on both sides: only
    pairs across; else all pairs."""
    joined, index = _Joined(), np.arange(len(side))
    two = side.max(initial=0) > 0
    for i in index:
        if two and side[i]:
            continue
        others = index[side > 0] if two else index[i + 1:]
        for j in _alike(sketches, sizes, i, others, percent):
            if joined.top(cls[i]) != joined.top(cls[j]) and confirm(i, j):
                joined.join(cls[i], cls[j])
                yield i, j


def _bucket_links(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["grp", "low", "high"]):
            sketches = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(len(pdf), VALUES)
            found = list(_spanning_links(pdf["side"].to_numpy(), pdf["cls"].tolist(), sketches, pdf["n"].to_numpy(),
                                         percent, lambda i, j: True))
            ids = pdf["doc_id"].tolist()
            yield pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["x", "y"], dtype="int64")
    return run


def _text_links(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["grp", "low", "high"]):
            sets = shingle_sets([t.encode("utf-8", "replace") for t in pdf["text"]], width)
            sizes = np.array([len(s) for s in sets])
            full = sizes > 0
            sketches = np.zeros((len(sets), VALUES), dtype=np.uint8)
            if full.any():
                sketches[full] = _sketch(minhash([s for s in sets if len(s)]))

            def confirm(i: int, j: int) -> bool:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return bool(both) and 100 * both >= percent * (sizes[i] + sizes[j] - both)

            found = list(_spanning_links(pdf["side"].to_numpy(), pdf["cls"].tolist(), sketches, sizes, percent, confirm))
            ids = pdf["doc_id"].tolist()
            yield pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["x", "y"], dtype="int64")
    return run


def _pair_filter(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            a, b = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint8).reshape(len(pdf), VALUES) for c in ("sx", "sy"))
            small, large = pdf[["nx", "ny"]].min(axis=1), pdf[["nx", "ny"]].max(axis=1)
            yield pdf.loc[((a == b).sum(axis=1) >= banding(percent).least_equal) & (100 * small >= percent * large), ["x", "y"]]
    return run


def cells(rows: DataFrame, block: int = BLOCK_ROWS, weights: int = BLOCK_SHINGLES) -> DataFrame:
    """``rows`` (grp, cls, doc_id, ...) dealt into cells (grp, low, high, side)
    such that any two rows of a group whose classes differ meet in a cell.

    The group's largest class needs no comparison with itself. Its rows and
    the others' are cut into blocks of about ``block`` rows (and of about
    ``weights`` in a column ``weight``, if there is one), and a cell pairs
    two blocks, at most one of them of the largest class. Rows of a group of
    one class go nowhere. So copies are made in proportion to the blocks of
    the *other* classes, however large the largest is.
    """
    weight = F.col("weight") if "weight" in rows.columns else F.lit(0)
    per = rows.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("k"), F.sum(weight).alias("w"))
    top = per.groupBy("grp").agg(F.max(F.struct("k", "cls", "w")).alias("top"), F.sum("k").alias("all"), F.sum("w").alias("all_w"))
    blocks = lambda k, w: F.greatest(F.ceil(k / block), F.ceil(w / weights)).cast("int")
    t = F.col("top")
    top = top.filter(F.col("all") > t["k"]).select(
        "grp", t["cls"].alias("largest"), blocks(t["k"], t["w"]).alias("nl"),
        blocks(F.col("all") - t["k"], F.col("all_w") - t["w"]).alias("no"))
    j = rows.join(top, "grp")
    main = F.col("cls") == F.col("largest")
    own = F.pmod(F.xxhash64("doc_id"), F.when(main, F.col("nl")).otherwise(F.col("no"))).cast("int")
    j = j.withColumn("own", F.when(main, F.col("no") + own).otherwise(own))
    others = F.when(main, F.sequence(F.lit(0), F.col("no") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("no") + F.col("nl") - 1))
    j = j.withColumn("other", F.explode(others))
    return j.select(*rows.columns, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                    (F.col("own") > F.col("other")).cast("int").alias("side"))


def _by_cell(rows: DataFrame, run) -> DataFrame:
    dealt = rows.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "doc_id")
    return dealt.mapInPandas(run, "x long, y long")


def families(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, root): sets that may be linked, directly or through others, have
    one root; sets without any candidate are not listed.

    ``nodes`` (doc_id, n, keys, sketch) has each distinct set once. The half
    keys that only one set has are dropped before pairs of them are formed, so
    a set without a likeness costs two rows a band, not one a table. In each
    table bucket all are first compared with the smallest id by sketch. Where
    that leaves buckets in several families, their rows are gathered by first
    half and compared in blocks, which hand on a spanning forest. Pairs are
    never listed.
    """
    bands = banding(percent).bands
    half = nodes.select("doc_id", F.posexplode("keys").alias("at", "key"))
    live = half.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
    half = pin(half.join(live, "key"), "near-half-keys")
    tables = (half.filter(F.col("at") < bands).select("doc_id", F.col("key").alias("a"))
              .join(half.filter(F.col("at") >= bands).select("doc_id", F.col("key").alias("b")), "doc_id")
              .select("doc_id", "a", F.xxhash64("a", "b").alias("grp")))
    stat = tables.groupBy("grp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    buckets = pin(tables.join(stat, "grp"), "near-buckets")
    side = lambda c: nodes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    pairs = buckets.filter("doc_id <> first").select(F.col("first").alias("x"), F.col("doc_id").alias("y")).distinct()
    first = (pairs.join(side("x"), "x").join(side("y"), "y")
             .select("x", "y", "nx", "ny", "sx", "sy").mapInPandas(_pair_filter(percent), "x long, y long"))
    labels = pin(components(first), "near-families")
    known = labels.select(F.col("node").alias("doc_id"), F.col("root").alias("cls"))
    rest = (buckets.filter("k > 2").select("grp", "a", "doc_id").join(known, "doc_id", "left")
            .select("grp", "a", "doc_id", F.coalesce("cls", "doc_id").alias("cls")))
    mixed = rest.groupBy("grp").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("grp")
    # All tables of one first half lie within the sets that share it, so these
    # are compared once, not once for each second half.
    rest = pin(rest.join(mixed, "grp").select(F.col("a").alias("grp"), "doc_id", "cls").distinct(), "near-mixed")
    if not rest.take(1):
        return labels
    dealt = cells(rest).join(nodes.select("doc_id", "n", "sketch"), "doc_id")
    more = pin(_by_cell(dealt, _bucket_links(percent)).distinct(), "near-more")
    return pin(relabelled(labels, more), "near-families")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A text's set is its distinct ``width``-word shingles. Texts are linked
    when 100 * intersection >= ``percent`` * union, checked on the full sets;
    component_id is the smallest id reachable over links, kept says that it
    is the row's own.

    1. Signatures, one pass over the texts. Equal sets (by a 128-bit hash of
       the whole set) become one node.
    2. Families of nodes that share a table of the tensored banding and agree
       in their sketches (``families``).
    3. Families' texts are brought together in blocks of bounded size, where
       sets are built anew and links confirmed. Families of several blocks go
       through a second pass over pairs of blocks, for what isn't connected
       yet. Tasks hand on spanning links only.
    4. Connected components of the links.

    Defined results: null, empty or word-less texts have an empty set and are
    linked with nothing; texts of fewer words than ``width`` are one shingle;
    rows with a null id are not linked (component_id null, kept); rows that
    repeat an id stand for one document that has the links of all its texts;
    an empty table gives an empty table; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sig = pin(texts.mapInArrow(_signatures(width, banding(percent)), SIGNATURE), "near-signatures")
    nodes = pin(sig.filter("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first(F.struct("n", "keys", "sketch")).alias("s"))
        .select("digest", "doc_id", "s.n", "s.keys", "s.sketch"), "near-nodes")
    family = families(nodes, percent)
    size = family.join(nodes.select(F.col("doc_id").alias("node"), "n"), "node").groupBy("root").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    size = size.filter("k > 1").select("root", F.greatest(
        F.ceil(F.col("k") / BLOCK_ROWS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = pin(family.join(size, "root").join(nodes.select(F.col("doc_id").alias("node"), F.col("n").alias("weight")), "node").select(
        F.col("root").alias("grp"), F.col("node").alias("doc_id"), "blocks", "weight",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("low")), "near-members")
    # The texts of the families' nodes; equal sets of other rows are left out.
    picked = pin(texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "near-texts")
    inside = members.join(picked, "doc_id").select(
        "grp", "low", F.col("low").alias("high"), F.lit(0).alias("side"), F.col("doc_id").alias("cls"), "doc_id", "text")
    links = pin(_by_cell(inside, _text_links(width, percent)), "near-links")
    labels = pin(components(links), "near-components")
    many = members.filter("blocks > 1")
    if many.take(1):
        known = labels.select(F.col("node").alias("doc_id"), F.col("root").alias("cls"))
        open_ = many.join(known, "doc_id", "left").select("grp", "doc_id", "weight", F.coalesce("cls", "doc_id").alias("cls"))
        more = pin(_by_cell(cells(open_).join(picked, "doc_id"), _text_links(width, percent)).distinct(), "near-more")
        labels = pin(relabelled(labels, more), "near-components")
    rows = sig.select("doc_id", "n", F.coalesce("digest", F.concat(F.lit("id").cast("binary"), F.col("doc_id").cast(
        "string").cast("binary"))).alias("digest"))
    sets = nodes.select("digest", F.col("doc_id").alias("node")).join(
        labels, "node", "left").select("digest", "node", F.coalesce("root", "node").alias("root"))
    out = rows.join(sets, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, all columns kept; only
    the dropped ids are joined."""
    gone = near_duplicates(docs, id_col, text_col, **options).filter(~F.col("kept")).select(
        F.col("doc_id").alias("gone_id")).distinct()
    gone = pin(gone, "near-dropped")
    name = fresh(docs, "gone_id")
    gone = gone.withColumnRenamed("gone_id", name)
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
