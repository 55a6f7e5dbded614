import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from halyard.llm import prefix_trie as PT
from halyard.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def brute(rows, width=100):
    """The trie of (conv_id, turn, role, text) rows, node by node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = defaultdict(list)
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, width))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(made[c]) + 1):
            nodes[made[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(members) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children[path],
                    leaves[path], saved[path], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(conversations, **options):
    return sorted((tuple(r) for r in PT.prefix_trie(conversations, **options).collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, SF)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def made_up(seed=2):
    """Long and short conversations, many equal ones, null and tied turns."""
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(-130, -100), *range(1000, 1130), 2**40, None]:
        kind = r.random()
        turns = ["hello", "hi there", "ok", "ok", "bye"] if kind < 0.4 else [
            r.choice(["a", "bb", "漢字", "", None]) for _ in range(r.choice([1, 2, 3, 4, 7, 23]))]
        for k, text in enumerate(turns):
            turn = None if r.random() < 0.05 else k if r.random() < 0.9 else max(0, k - 1)
            rows.append((c, turn, r.choice(["user", "assistant"]) if kind > 0.9 else ["user", "assistant"][k % 2], text))
    rows += rows[:7] + [(1001, None, None, None), (1002, 0, None, "x" * 5000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("options", [{}, {"fold": 2, "depth": 6, "shard_rows": 5}, {"fold": 5, "depth": 11, "shard_rows": 1000}])
def test_edges(spark, options):
    rows = made_up()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS d", "'x' AS part", "2 AS p1", "role AS home")
    assert trie(frame, **options) == brute(rows)


def test_no_and_turnless_conversations(spark):
    assert PT.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert PT.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0
    lost = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)  # its base is absent
    rows = [(lost, 0, "user", "a")]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == brute(rows) and brute(rows)[0][5] == 1


def test_one_long_conversation(spark):
    rows = [(100, k, "user", f"t{k % 7}") for k in range(300)] + [(101, k, "user", f"t{k % 7}") for k in range(250)]
    assert trie(spark.createDataFrame(rows, SCHEMA), fold=70, depth=90, shard_rows=50) == brute(rows)


def test_parentheses():
    r = random.Random(8)
    for size in (1, 2, 63, 64, 65, 700, 3000):
        opens, depth = [], 0
        left = size
        while left or depth:
            if left and (not depth or r.random() < (0.9 if size > 1000 and left > size // 2 else 0.5)):
                opens.append(True)
                depth, left = depth + 1, left - 1
            else:
                opens.append(False)
                depth -= 1
        tree, stack, want = PT.Parentheses(np.array(opens)), [], {}
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(opens)
        close = tree.findclose(at)
        assert dict(zip(at.tolist(), close.tolist())) == want
        pairs = [sum(opens[k] and not opens[k + 1] for k in range(a, b)) for a, b in zip(at, close)]
        assert tree.leaves(at, close).tolist() == pairs
