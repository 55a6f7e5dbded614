"""Each stage of the pipeline against a brute-force version of it."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from halyard.llm.quality import RULES, View
from halyard.llm.queries import table, tokenizer_path
from halyard.llm.sql import OP1
from tests.llm.test_exact_dedup import SPACE
from tests.llm.test_near_dup import brute as near_brute
from tests.oracle_compare import duck_connect

SF = "/root/testdata/sf0.001"


def test_rows_without_an_id_of_their_own(spark):
    """A table appended twice, with a third of its ids null: one row of each
    text stays, near copies go, and rows are copied as the mix says."""
    texts = [" ".join(f"t{k}w{i}" for i in range(10 + k)) for k in range(30)]
    rows = [(None if k % 3 == 0 else k // 2 * 2, t, f"s{k % 2}") for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = corpus_pipeline.exact_dedup(spark, docs, SF)
    assert once.columns == docs.columns and sorted(r.text for r in once.collect()) == sorted(texts)
    named = spark.createDataFrame([(None, "a b c", "s"), (7, "a  b c", "s"), (9, "a b c", "s")], docs.schema)
    assert [r.doc_id for r in corpus_pipeline.exact_dedup(spark, named, SF).collect()] == [7]
    near = spark.createDataFrame([(None, texts[29], "s"), (None, texts[29] + " end", "s"), (None, texts[5], "s"),
                                  (4, texts[8], "s"), (4, texts[8] + " end", "s"), (4, texts[9], "s")], docs.schema)
    kept = sorted(r.text.split()[0] for r in corpus_pipeline.near_dedup(spark, near, SF).collect())
    assert kept == sorted(["t29w0", "t5w0", "t8w0", "t9w0"])
    size = lambda t: len(t.split())
    got = Counter()
    for r in corpus_pipeline.mix(spark, docs, SF).collect():
        got[r.source] += size(r.text)
    total = sum(size(t) for _, t, _ in rows)
    assert abs(got["s0"] - total / 3) <= 40 and abs(got["s1"] - total * 2 / 3) <= 40


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    outs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert k == 4 or docs.columns == columns
        outs.append(docs.collect())
    good = {i: r for i, r in rows.items() if not any(rule.rejects(View(r.text)) for rule in RULES)}
    assert {r.doc_id: r for r in outs[0]} == good and len(outs[0]) == len(good)
    first = {}
    for i in sorted(good):
        first.setdefault(SPACE.sub(" ", good[i].text), i)
    assert sorted(r.doc_id for r in outs[1]) == sorted(first.values())
    kept = [i for i, _, _, ok in near_brute([(i, good[i].text) for i in first.values()], 5) if ok]
    assert sorted(r.doc_id for r in outs[2]) == kept
    con = duck_connect(SF)
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('%s/near_dedup/*.parquet')" % tmp_path)
    want = {r[0]: r[4] // r[1] if r[1] else 0 for r in con.execute(OP1).fetchall()}
    copies = Counter(r.doc_id for r in outs[3])
    assert {i: copies[i] for i in kept} == want and all(r == rows[r.doc_id] for r in outs[3])
    t = Tokenizer.from_file(tokenizer_path())
    tokens = Counter()
    for r in outs[4]:
        tokens[r.doc_id] += r.length
    assert tokens == {i: n * (len(t.encode(rows[i].text, add_special_tokens=False).ids) + 1) for i, n in copies.items()}
