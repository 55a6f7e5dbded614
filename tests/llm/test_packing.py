import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from halyard.llm.packing import _Words, cut_pieces, first_fit_decreasing, pack, pack_documents, sequences
from halyard.llm.queries import table, tokenizer_path

PATH = tokenizer_path()


def naive(lengths, capacity):
    bins, out = [], []
    for n in lengths:
        k = next((k for k, used in enumerate(bins) if used + n <= capacity), len(bins))
        if k == len(bins):
            bins.append(0)
        out.append((k, bins[k]))
        bins[k] += n
    return out


def test_first_fit():
    r = random.Random(4)
    for n in (0, 1, 2, 3, 50, 333):
        lengths = sorted((r.choice([1, 7, 100, 2048, r.randint(1, 2048)]) for _ in range(n)), reverse=True)
        assert first_fit_decreasing(lengths, 2048) == naive(lengths, 2048)


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, direct, seq_len=2048):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids, at = direct(text), 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            piece = np.array(ids[at:at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece))
            at += r.length
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= seq_len
    return sum(r.length for r in rows) / (len(seq) * seq_len)


def test_whole_table(spark, direct):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    fill = check(pack_documents(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, direct)
    assert fill > 0.97


def test_edges(edge_docs, no_docs, direct):
    docs = edge_docs.filter("doc_id is not null and doc_id <> 3")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts[900] = "x<|endoftext|>y it's we'll  Á  　nb sp 12345 \x85 ﬀ İ Σ"
    texts[901] = "Word Word, WORD!! É,*** ÀÉß. don't d'Été... ﬁx. İx. ΟΔΟΣ. ª. \u1100\u1161. e\u0301x, x\u0301. <|endoftext|> a<|b. (a) 1a. µ."
    spark = edge_docs.sparkSession
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pack_documents(docs, PATH, seq_len=2048).collect(), texts, direct)
    rows = pack_documents(edge_docs, PATH)
    assert rows.select("doc_id").distinct().count() == edge_docs.select("doc_id").distinct().count()
    assert rows.filter("start = 0").count() == edge_docs.count()
    assert pack_documents(no_docs, PATH).count() == 0


def test_groups_are_packed_alone_and_ids_come_back(spark, direct):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    pieces = cut_pieces(docs, PATH, with_ids=True)
    packed = pack(pieces, group_pieces=40)
    groups = {r.sequence_id >> 32 for r in packed.select("sequence_id").collect()}
    assert len(groups) > 1
    whole = {r.sequence_id: np.frombuffer(r.ids, dtype="<u4") for r in sequences(packed).collect()}
    assert all(len(x) == 2048 for x in whole.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in packed.drop("ids").collect()[::17]:
        assert whole[r.sequence_id][r.offset:r.offset + r.length].tolist() == direct(texts[r.doc_id])[r.start:r.start + r.length]


def test_every_letter_beside_punctuation(direct):
    """Letters that normalise to a letter and a mark are no stem of letters."""
    words = _Words(PATH)
    ids = lambda text: np.frombuffer(words.encode(text), dtype="<u4").tolist()
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    assert "\u0130" in letters and ids("B\u0130LG\u0130.") == direct("B\u0130LG\u0130.")[:-1]
    for form in ("{}, ({}) x{}.", "{}a{}! -{}"):
        for at in range(0, len(letters), 50):
            text = " ".join(form.replace("{}", c) for c in letters[at:at + 50])
            assert ids(text) == direct(text)[:-1], text


def test_null_and_repeated_ids_are_spread_over_groups(spark):
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, 0, 100 + k % 900, 1, 100) for k in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = pack(pieces, 1000, group_pieces=100).collect()
    per = defaultdict(int)
    for r in got:
        per[r.sequence_id >> 32] += 1
    assert len(got) == 3000 and len(per) == 30 and max(per.values()) < 200
