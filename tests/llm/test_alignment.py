from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from halyard.llm import alignment
from halyard.llm.queries import QUERIES, table, tokenizer_path

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TRICKY = ["hello  world", "a\nb\n\n c", " leading", "trailing ", "a▁b c", "ﬁ Å á", "x　y z", "  a  b",
          "<|endoftext|> <s> </s> <0x41> <unk>", "don't we'll I'M 'tis", "1234567 890 1.5e10", "\x00 \x1c a \x85 b",
          "\U0001f468‍\U0001f469‍\U0001f467 family", "​ ​z ﻿ q᠎ r", "====== ---- ______",
          "สวัสดี 你好世界", "a" * 5000, "word " * 300, "\t\ttabs\tin \t text", "नमस्ते שלום"]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(A, B)


def plain(tokenizers, text):
    """Groups of the whole text, encoded at once."""
    text = text or ""
    a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
    b = tokenizers.b.encode(text)
    parts_a, parts_b = [tokenizers.a_bytes[i] for i in a], [tokenizers.b_bytes[i] for i in b]
    want = (" " + text).encode()
    if not text or b"".join(parts_a) != want or b"".join(parts_b) != want:
        return None
    ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
    both, groups, last = sorted(set(ends_a) & set(ends_b)), [], 0
    for end in both:
        groups.append(([i for i, e in zip(a, ends_a) if last < e <= end], [i for i, e in zip(b, ends_b) if last < e <= end]))
        last = end
    return groups


def brute(tokenizers, rows):
    held, every = defaultdict(set), []
    for k, (doc_id, text) in enumerate(rows):
        groups = plain(tokenizers, text) or []
        links = [(x, y) for a, b in groups for x in a for y in b]
        every.append((doc_id, groups, links))
        for pair in links:
            held[pair].add(k)
    top = Counter()
    for (x, _), docs in held.items():
        top[x] = max(top[x], len(docs))
    out = []
    for doc_id, groups, links in every:
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(len(held[p]) == top[p[0]] for p in links), sum(len(held[p]) for p in links),
                    sha256(shown.encode()).hexdigest() if groups else ""))
    links = Counter(p for _, _, ps in every for p in ps)
    return out, {(x, y, len(d), links[x, y], len(d) == top[x]) for (x, y), d in held.items()}


def test_query_against_whole_texts(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = QUERIES["op13_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(tokenizers, rows)[0])


def test_tricky_texts_over_many_segments(spark, tokenizers, edge_docs, no_docs):
    rows = [(i % 17 if i % 5 else None, t) for i, t in enumerate(TRICKY * 3)] + [(r.doc_id, r.text) for r in edge_docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS segment", "'x' AS code")
    want, pairs = brute(tokenizers, rows)
    for options in ({}, {"segment_docs": 3, "segment_postings": 50}):
        got, found = alignment.align_tokenizers(docs, A, B, 32_000, **options)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert {(r.a_id, r.b_id, r.n_docs, r.n_links, r.best) for r in found.collect()} == pairs
    got, found = alignment.align_tokenizers(no_docs, A, B, 32_000)
    assert got.count() == 0 and found.count() == 0


def test_pieces_are_encoded_as_in_the_whole_text(tokenizers):
    words = [w for t in TRICKY for w in t.split(" ")]
    rng = np.random.default_rng(3)
    aligner = alignment._Aligner(A, B)
    texts = [" ".join(rng.choice(words, 40)) for _ in range(200)]
    for text, row in zip(texts, aligner.align(texts)[0]):
        groups = plain(tokenizers, text) or []
        assert row[:3] == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups)), text


def test_planes():
    rng = np.random.default_rng(1)
    doc, code = rng.integers(0, 60_000, 400_000), rng.integers(0, 40, 400_000) ** 2
    doc, code, n = alignment._summed(doc, code, rng.integers(1, 9, 400_000))
    for pair, docs, links, planes in alignment.pair_planes(doc, code, n):
        of = code == pair
        total = np.zeros(65_536, dtype=np.int64)
        for k, plane in enumerate(planes):
            assert len(plane) <= alignment.BITS
            total[alignment.unpack_bitmap(plane)] += 1 << k
        assert docs == of.sum() and links == n[of].sum()
        assert np.array_equal(np.flatnonzero(total), doc[of]) and np.array_equal(total[doc[of]], n[of])
