import random
from itertools import combinations

import numpy as np
import xxhash

from halyard.llm import simhash
from halyard.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows, reach=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= reach:
            root[top(b)] = top(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, f"{p:016x}", least.get(top(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))), key=str)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = QUERIES["op12_simhash_vptree"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = sorted((tuple(r) for r in simhash.simhash_duplicates(edge_docs).collect()), key=str)
    assert got == brute(rows)
    assert simhash.simhash_duplicates(no_docs).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in simhash.simhash_duplicates(nulls).collect()] == [None, None]


def test_long_text_goes_through_chunks():
    text = " ".join(f"w{i % 331}x{i}" for i in range(70_000))
    words = text.encode().split()
    n = len(words) - 3
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(n)], dtype="<u8")
    want = sum(1 << k for k in range(64) if 2 * int((h >> np.uint64(k) & np.uint64(1)).sum()) > n)
    assert simhash.fingerprint(text.encode()) == want


def clouds(seed=5):
    """Random fingerprints, chains of small steps, and a dense cloud that
    holds a third of all."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(600)} | {0, (1 << 64) - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(8):
            for _ in range(r.randint(1, 6)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    centre = r.getrandbits(64)
    out |= {centre ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for _ in range(600)}
    return sorted(out)


def test_links_through_many_shards_and_cells(spark):
    prints = clouds()
    rows = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    nodes = spark.createDataFrame(rows, "fp long")
    label = {}

    def top(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    n = 0
    for x, y in simhash.fingerprint_links(nodes, 4, shard=40, cell=64).collect():
        assert ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 4
        n += 1
        label[top(x)] = top(y)
    signed = [r[0] for r in rows]
    want = {}

    def best(x):
        while want.setdefault(x, x) != x:
            x = want[x]
        return x

    pairs = 0
    for a, b in combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
            pairs += 1
            want[best(a)] = best(b)
    same = lambda f: {frozenset(x for x in signed if f(x) == root) for root in {f(x) for x in signed}}
    assert same(top) == same(best) and pairs > 10_000


def test_visits_lose_no_pair():
    prints = np.array(clouds(9), dtype=np.uint64)
    tree, shards = simhash.vantage_tree(prints[::3], 24, 4)
    assert shards == 24
    home, seen = {}, {}
    for k, at, own in simhash.visits(tree, prints, 4):
        for i in at.tolist():
            seen.setdefault(i, set()).add(k)
            if own:
                assert home.setdefault(i, k) == k
    assert len(home) == len(prints)
    for i, j in combinations(range(len(prints)), 2):
        if int(prints[i] ^ prints[j]).bit_count() <= 4:
            assert home[i] in seen[j] or home[j] in seen[i]
