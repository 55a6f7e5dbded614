import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm.graph import components
from halyard.llm.near_dup import banding, cells, drop_near_duplicates, near_duplicates, shingle_sets


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words_of(text)
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(zip(*[w[i:] for i in range(width)]))


def brute(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets.items())


def family_texts(seed=3):
    """Originals, copies with a few edits, chains of edits, and a passage that
    many texts share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    out = []
    for k in range(60):
        base = [word() for _ in range(r.randint(4, 200))]
        if k % 3 == 0:
            base = base + passage
        out.append(base)
        for _ in range(k % 5):
            base = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 50)):
                base[r.randrange(len(base))] = word()
            out.append(base)
    r.shuffle(out)
    return [(i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w)) for i, w in enumerate(out)]


def test_against_all_pairs(spark):
    rows = family_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (4, 5):
        got = sorted(tuple(r) for r in near_duplicates(docs, width=width).collect())
        assert got == brute(rows, width)


def test_lower_thresholds_lose_no_link(spark):
    rows = family_texts(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 60, 95):
        assert sorted(tuple(r) for r in near_duplicates(docs, percent=percent).collect()) == brute(rows, 5, percent)
    assert banding(80) == (10, 2, 82)
    for percent in (0, 101, 5):
        with pytest.raises(ValueError):
            banding(percent)


def test_edges(edge_docs, no_docs):
    got = near_duplicates(edge_docs, width=4)
    assert got.count() == edge_docs.count()
    assert near_duplicates(no_docs).count() == 0
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].n_shingles == 0 and by[0][0].component_id == 0 and by[0][0].kept
    assert {r.component_id for r in by[100]} == {3} and not by[100][0].kept
    assert by[5][0].component_id == 4  # "a  b" as "a b"
    assert by[13][0].component_id == by[14][0].component_id == by[15][0].component_id == 12
    assert all(r.component_id is None and r.kept for r in by[None])
    out = drop_near_duplicates(edge_docs, width=4)
    assert out.columns == edge_docs.columns and out.filter("doc_id in (13, 14, 15, 100)").count() == 0


def test_many_alike_texts_span_blocks(spark):
    """One family of more texts than a block, and strays at its rim."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1300):
        w = list(base)
        w[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs, width=4)
    assert got.filter("component_id = 0").count() == 1300 and got.filter("kept").count() == 1


def test_cells_meet_every_pair_of_classes(spark):
    rows = [(1, 0, i) for i in range(40)] + [(1, 1 + i % 3, 100 + i) for i in range(17)] + [(2, 5, i) for i in range(9)]
    dealt = cells(spark.createDataFrame(rows, "grp long, cls long, doc_id long"), block=5).collect()
    assert {r.grp for r in dealt} == {1}
    met = set()
    for a, b in combinations(dealt, 2):
        if (a.low, a.high) == (b.low, b.high) and (a.side != b.side or a.low == a.high):
            met.add(frozenset((a.doc_id, b.doc_id)))
    want = {frozenset((a[2], b[2])) for a, b in combinations([x for x in rows if x[0] == 1], 2) if a[1] != b[1]}
    assert want <= met


def test_cells_bound_the_weight_of_a_block(spark):
    rows = [(1, i % 4, i, 300 if i % 5 == 0 else 10) for i in range(120)]
    dealt = cells(spark.createDataFrame(rows, "grp long, cls long, doc_id long, weight long"), block=100, weights=600).collect()
    sums = {}
    for r in dealt:
        sums[r.low, r.high, r.side] = sums.get((r.low, r.high, r.side), 0) + r.weight
    assert len(sums) > 20 and max(sums.values()) < 3 * 600
    met = {frozenset((a.doc_id, b.doc_id)) for a, b in combinations(dealt, 2)
           if (a.low, a.high) == (b.low, b.high) and (a.side != b.side or a.low == a.high)}
    assert {frozenset((a[2], b[2])) for a, b in combinations(rows, 2) if a[1] != b[1]} <= met


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [
        (500, i) for i in range(501, 900)] + [(7, 7)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: top(x) for x in list(root)}


def test_sets_of_whole_texts():
    long = " ".join(f"w{i % 977}x{i}" for i in range(400_000))  # over a chunk
    texts = [long, "", "a b", "A  B", "a b c d e", None, "ab c"]
    sets = shingle_sets([t.encode() if t is not None else None for t in texts], 4)
    assert [len(s) for s in sets] == [len(shingles(t, 4)) for t in texts]
    assert np.array_equal(sets[2], sets[3]) and not np.array_equal(sets[2], sets[6])
    alone = shingle_sets([long.encode()], 4)[0]
    assert np.array_equal(alone, sets[0])
