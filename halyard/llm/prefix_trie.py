"""The trie of conversation prefixes, from balanced parentheses in shards."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import pin

# The longest head a conversation takes from its base, plus one.
HEADS = 6
# Turns whose prefixes one window folds; turns of a path that one shard holds.
FOLD, DEPTH = 10_000, 4_096
# Rows (turns of paths) of one shard, about: at most so many and one path's.
SHARD_ROWS = 200_000
# Leading turns by which paths are dealt to shards.
KEYS = 6
# Parentheses of a block whose least excess is kept.
BLOCK = 64
# Characters of ids that are hashed as one row.
IDS = 1 << 16

_KEY = [f"k{j}" for j in range(1, KEYS + 1)]


class Parentheses:
    """A forest as balanced parentheses, with the least excess of each block."""

    def __init__(self, opens: np.ndarray) -> None:
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        n = len(opens)
        self.blocks = -(-n // BLOCK)
        padded = np.full(self.blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:n] = self.excess
        self.least = padded.reshape(-1, BLOCK).min(axis=1) if n else padded
        # A leaf is an opening parenthesis right before a closing one.
        self.leaf = np.zeros(n, dtype=bool)
        if n:
            self.leaf[:-1] = opens[:-1] & ~opens[1:]
        self.leaf_rank = np.concatenate([[0], np.cumsum(self.leaf)])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one of ``at``: the next
        place whose excess is one less. Scans the rest of the own block, skips
        blocks whose least excess is not below, then scans the block found."""
        want, pos, out = self.excess[at] - 1, at + 1, np.full(len(at), -1)
        todo = np.arange(len(at))
        while len(todo):
            hit = self.excess[pos[todo]] == want[todo]
            out[todo[hit]] = pos[todo[hit]]
            todo = todo[~hit]
            pos[todo] += 1
            edge = todo[pos[todo] % BLOCK == 0]
            while len(edge):
                edge = edge[self.least[pos[edge] // BLOCK] > want[edge]]
                pos[edge] += BLOCK
        return out

    def leaves(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.leaf_rank[end + 1] - self.leaf_rank[start]


def parentheses_of(paths: list[list[int]]) -> tuple[Parentheses, np.ndarray]:
    """The forest of sorted paths and its nodes in preorder. Paths that share
    a node share all nodes before it."""
    opens, nodes, last = [], [], []
    for path in paths:
        same = 0
        while same < min(len(last), len(path)) and last[same] == path[same]:
            same += 1
        opens += [False] * (len(last) - same) + [True] * (len(path) - same)
        nodes += path[same:]
        last = path
    opens += [False] * len(last)
    return Parentheses(np.array(opens, dtype=bool)), np.array(nodes, dtype=np.int64)


def subtree_sums(paths: list[list[int]], gain: np.ndarray, more: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, gain) summed over each node's subtree. ``more`` are leaves
    that hang below a node elsewhere; nodes that are ``cut`` go on elsewhere
    and are no leaves here."""
    tree, nodes = parentheses_of(sorted(paths))
    start = np.flatnonzero(tree.opens)
    end = tree.findclose(start)
    before = np.concatenate([[0], np.cumsum(tree.opens)])  # rank of opening parentheses
    first, last = before[start], before[end + 1]
    over = lambda values: np.concatenate([[0], np.cumsum(values[nodes])])  # noqa: E731  cumulative in preorder
    sums = lambda values: over(values)[last] - over(values)[first]
    leaves, saved = np.zeros(len(gain), np.int64), np.zeros(len(gain), np.int64)
    leaves[nodes] = tree.leaves(start, end) - sums(cut.astype(np.int64)) + sums(more)
    saved[nodes] = sums(gain)
    return leaves, saved


def _shards(shard_rows: int):
    """Rows of paths (p1, p2, conv_id, d, gain, more, cut, first, q1, q2),
    sorted by path, to rows of nodes with their sums within a shard."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pd.MultiIndex.from_arrays([pdf["p1"], pdf["p2"]])
        code, _ = pd.factorize(key)
        conv = pdf["conv_id"].to_numpy()
        cuts = np.flatnonzero(np.diff(conv)) + 1
        paths = [p.tolist() for p in np.split(code, cuts)]
        n = code.max() + 1
        cut = np.zeros(n, dtype=bool)
        cut[code[pdf["cut"].to_numpy(dtype=bool)]] = True
        leaves, saved = subtree_sums(paths, _by_code(code, pdf["gain"], n), _by_code(code, pdf["more"], n), cut)
        node = pdf.drop_duplicates(["p1", "p2"])
        at = code[node.index.to_numpy()]
        return node[["p1", "p2", "q1", "q2", "d"]].assign(leaves=leaves[at], saved=saved[at])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= shard_rows:
                rows = pd.concat(held, ignore_index=True)
                conv = rows["conv_id"].to_numpy()
                upto = int(np.flatnonzero(conv != conv[-1])[-1]) + 1 if (conv != conv[-1]).any() else 0
                if upto:
                    yield build(rows.iloc[:upto].reset_index(drop=True))
                held, size = [rows.iloc[upto:]], len(rows) - upto
        if size:
            yield build(pd.concat(held, ignore_index=True))
    return run


def _by_code(code: np.ndarray, values: pd.Series, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, code, values.to_numpy())
    return out


def _id_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (p1, p2, conv_id) to rows (p1, p2, seq, ids) of joined ids."""
    part, seq = TaskContext.get().partitionId(), 0
    for pdf in batches:
        out = []
        for (p1, p2), ids in pdf.groupby(["p1", "p2"], sort=False)["conv_id"]:
            held, size = [], 0
            for text in map(str, ids.tolist()):
                held.append(text)
                size += len(text) + 1
                if size >= IDS:
                    out.append((p1, p2, ",".join(held)))
                    held, size = [], 0
            if held:
                out.append((p1, p2, ",".join(held)))
        frame = pd.DataFrame(out, columns=["p1", "p2", "ids"])
        frame["seq"] = (part << 32) + seq + np.arange(len(frame))
        seq += len(frame)
        yield frame[["p1", "p2", "seq", "ids"]]


def _id_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (p1, p2, seq, ids) to the SHA-256 of each node's joined ids."""
    last, digest = None, None
    for pdf in batches:
        out = []
        for p1, p2, ids in zip(pdf["p1"].tolist(), pdf["p2"].tolist(), pdf["ids"]):
            if last == (p1, p2):
                digest.update(b"," + ids.encode())
                continue
            if last is not None:
                out.append((*last, digest.hexdigest()))
            last, digest = (p1, p2), sha256(ids.encode())
        yield pd.DataFrame(out, columns=["p1", "p2", "ends_sha256"])
    if last is not None:
        yield pd.DataFrame([(*last, digest.hexdigest())], columns=["p1", "p2", "ends_sha256"])


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn_hash, chars). A conversation of any length
    is numbered part by part, each part's offset added after."""
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    order = ["conv_id", "turn", "role", "text"]
    hashed = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = pin(c.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"),
        hashed.alias("turn_hash"), F.length("text").cast("bigint").alias("chars")), "trie-rows")
    here = Window.partitionBy("conv_id", "part").orderBy("seq")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.withColumn("at", F.row_number().over(here)).join(offset, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") + F.col("offset")).cast("bigint").alias("pos"), "turn_hash", "chars")


def _head_length() -> Column:
    return F.crc32(F.col("conv_id").cast("string")) % HEADS


def rebuilt_turns(conversations: DataFrame, width: int = 100) -> tuple[DataFrame, DataFrame]:
    """(ids, turns): every conv_id c, and its rebuilt turns (conv_id, d from
    1, turn_hash, chars): the first h turns of conversation c - c % ``width``,
    then c's own after its first h, with h = crc32(decimal c) % 6."""
    turns = pin(_turns(conversations), "trie-turns")
    base = F.col("conv_id") - F.col("conv_id") % width
    ids = pin(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "trie-ids")
    at_most = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shift = F.greatest(F.lit(0), _head_length() - F.coalesce("n_base", F.lit(0)))
    own = (turns.filter(F.col("pos") > _head_length()).withColumn("base", base).join(at_most, "base", "left")
           .select("conv_id", (F.col("pos") - shift).alias("d"), "turn_hash", "chars"))
    heads = turns.filter(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "turn_hash", "chars")
    taken = (ids.select("conv_id", base.alias("base")).join(heads, "base").filter(F.col("d") <= _head_length())
             .select("conv_id", "d", "turn_hash", "chars"))
    return ids.select("conv_id"), own.unionByName(taken)


def prefixes(turns: DataFrame, fold: int = FOLD) -> DataFrame:
    """``turns`` (conv_id, d, turn_hash, chars) with the key (p1, p2) of the
    prefix that each ends, and of its parent (q1, q2); the root's is (0, 0).

    A key is the exclusive or of 120-bit hashes of (d, turn), so a long
    conversation is folded in blocks of ``fold`` turns."""
    lane = lambda k: F.conv(F.substring("h", 1 + 16 * k, 15), 16, 10).cast("bigint")
    t = (turns.withColumn("h", F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), "turn_hash")))
         .select("conv_id", "d", "chars", lane(0).alias("t1"), lane(1).alias("t2"), F.expr(f"(d - 1) div {int(fold)}").alias("block")))
    t = pin(t, "trie-terms")
    here = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = t.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("w1"), F.bit_xor("t2").alias("w2"))
    offset = whole.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"w{k}").over(before), F.lit(0)).alias(f"o{k}") for k in (1, 2)])
    p = t.select("*", *[F.bit_xor(f"t{k}").over(here).alias(f"x{k}") for k in (1, 2)]).join(offset, ["conv_id", "block"])
    key = lambda k: F.col(f"x{k}").bitwiseXOR(F.col(f"o{k}"))
    return p.select("conv_id", "d", "chars", *[key(k).alias(f"p{k}") for k in (1, 2)],
                    *[key(k).bitwiseXOR(F.col(f"t{k}")).alias(f"q{k}") for k in (1, 2)])


def _subtree_sums(paths: DataFrame, depth: int, shard_rows: int) -> DataFrame:
    """(p1, p2, leaves, saved) from ``paths``: a path for each leaf (conv_id,
    d, length, p1, p2, q1, q2, gain), the gain of a node in one of its rows.

    Paths are sorted and dealt to shards by their first turns. Each shard
    encodes its paths as balanced parentheses and sums its subtrees; nodes at
    the rim of shards, the shared spines, appear in several, and their sums
    are added up. Paths longer than ``depth`` are done block by block from
    below: what hangs under a block's last turn is added to it.
    """
    key = paths.groupBy("conv_id").agg(*[F.max(F.when(F.col("d") == j, F.col("p1"))).alias(k) for j, k in enumerate(_KEY, 1)])
    level = F.expr(f"(d - 1) div {int(depth)}")
    home = F.col("home")
    rows = pin(paths.join(key, "conv_id").select(
        *_KEY, "conv_id", "d", "p1", "p2", "q1", "q2", F.when(home, F.col("gain")).otherwise(0).alias("gain"), home.alias("home"),
        ((F.col("d") % depth == 0) & (F.col("length") > F.col("d"))).alias("cut"), level.alias("level")), "trie-paths")
    top = rows.agg(F.max("level")).first()[0]
    done, below = [], None
    for k in range(0 if top is None else top, -1, -1):
        part = rows.filter(F.col("level") == k)
        if below is None:
            part = part.withColumn("more", F.lit(0).cast("bigint"))
        else:
            part = part.join(below, ["p1", "p2"], "left").withColumn("more", F.when(home, F.coalesce("b_leaves", F.lit(0))).otherwise(0))
            part = part.withColumn("gain", F.col("gain") + F.when(home, F.coalesce("b_saved", F.lit(0))).otherwise(0))
        dealt = part.select(*_KEY, "conv_id", "d", "p1", "p2", "q1", "q2", "gain", "more", "cut").repartitionByRange(
            *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id", "d")
        found = dealt.mapInPandas(_shards(shard_rows), "p1 long, p2 long, q1 long, q2 long, d long, leaves long, saved long")
        sums = pin(found.groupBy("p1", "p2").agg(F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("d").alias("d"),
                                                 F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-sums")
        done.append(sums)
        below = sums.filter(F.col("d") == k * depth + 1).groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
            F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("p1", "p2", "d", "leaves", "saved")


def prefix_trie(conversations: DataFrame, width: int = 100, fold: int = FOLD, depth: int = DEPTH,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see
    ``rebuilt_turns``), the textless root included: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves (of its
    subtree), saved_tokens (over its subtree, (n_convs - 1) times the code
    points of each node's last text) and ends_sha256 (of the ids of the
    members that end there, ascending, joined by commas).

    Equal conversations are one path, however many they are. Defined results:
    turns go by turn (null first), then role, then text; null roles and texts
    are empty; rows with a null conv_id belong to no conversation; the base
    of a negative id is the next multiple toward zero; a conversation without
    rebuilt turns is a member of the root only; no conversation, no row;
    other columns are ignored.
    """
    ids, turns = rebuilt_turns(conversations, width)
    rows = pin(prefixes(turns, fold), "trie-prefixes")
    root = ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    nodes = pin(rows.groupBy("p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.min("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2")), "trie-nodes")
    children = pin(nodes.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children")),
                   "trie-children")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("d", "p1", "p2")).alias("e"))
    ends = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"e.{p}", F.lit(0)).cast("bigint").alias(p) for p in ("p1", "p2")],
                                                    F.coalesce("e.d", F.lit(0)).cast("bigint").alias("length"))
    ends = pin(ends, "trie-ends")
    leaves = ends.join(children, ["p1", "p2"], "left_anti").filter("length > 0").groupBy("p1", "p2").agg(
        F.min(F.struct("conv_id", "length")).alias("e")).select("e.conv_id", "e.length")
    paths = pin(rows.drop("chars").join(leaves, "conv_id"), "trie-leaf-paths")
    first = paths.groupBy("p1", "p2").agg(F.min("conv_id").alias("home_id"))
    gain = nodes.join(first, ["p1", "p2"]).select("p1", "p2", "home_id", ((F.col("n_convs") - 1) * F.col("chars")).alias("gain"))
    paths = paths.join(gain, ["p1", "p2"]).withColumn("home", F.col("conv_id") == F.col("home_id"))
    sums = pin(_subtree_sums(paths, depth, shard_rows), "trie-subtrees")

    order = ["p1", "p2", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _id_rows, "p1 long, p2 long, seq long, ids string")
    digests = joined.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "seq").mapInPandas(
        _id_digests, "p1 long, p2 long, ends_sha256 string")

    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.select("conv_id", "depth", "n_convs", "p1", "p2", "q1", "q2")
    deep = known.filter("depth > 1").join(parents, ["q1", "q2"])
    flat = known.filter("depth = 1").withColumn("parent_conv_id", F.lit(root["conv_id"]).cast("bigint"))
    below = (deep.unionByName(flat).drop("q1", "q2").join(sums.drop("d"), ["p1", "p2"])
             .withColumnRenamed("leaves", "n_leaves").withColumnRenamed("saved", "saved_tokens"))
    top = sums.filter("d = 1").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).select(
        F.lit(root["conv_id"]).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(root["n_convs"]).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("p1"), F.lit(0).cast("bigint").alias("p2"),
        F.lit(None).cast("bigint").alias("parent_conv_id"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens")).filter("n_convs > 0")
    every = below.unionByName(top).join(children, ["p1", "p2"], "left").join(digests, ["p1", "p2"], "left")
    return every.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs",
                        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))
