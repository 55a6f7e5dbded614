import re

from halyard.llm.quality import RULES, View, judge, keep_good, order_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    mark = set()
    for i in range(len(words) - 2):
        if any(words[j:j + 3] == words[i:i + 3] for j in range(len(words) - 2) if j != i):
            mark.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(mark)


def test_measures():
    texts = ["", "a b c a b c d", "a b c d", "x x x x", "l a\nl a\n\n \nm\nl a", "é ü \U0001f600 # <b>", "a\x0bb\x0cc\rd\te",
             "a b c x a b c y a b c"]
    for t in texts:
        v = View(t)
        assert (v.n_words, v.word_chars, v.n_symbols, v.line_counts[1], v.n_repeat_words) == brute(t)


def test_order_changes_work_not_verdicts(edge_docs):
    docs = edge_docs.select("doc_id", "text")
    key = lambda r: str((r.doc_id, r.text, r.verdict.kept))
    a = sorted(map(key, judge(docs, rules=RULES).collect()))
    assert a == sorted(map(key, judge(docs, rules=RULES[::-1]).collect()))
    assert all(r.verdict.rules_run == len(RULES) for r in judge(docs).filter("verdict.kept").collect())
    assert all(r.verdict.rules_run >= 1 and r.verdict.failed_rule for r in judge(docs).filter("not verdict.kept").collect())


def test_cheap_rules_that_reject_much_come_first(spark):
    rows = [(i, "few words" if i % 2 else " ".join(f"word{i}x{j}" for j in range(400))) for i in range(300)]
    order = order_rules(spark.createDataFrame(rows, "doc_id long, text string"))
    assert order[0][2] > 0 and sum(g for _, _, g in order[1:]) == 0
    assert {r.name for r, _, _ in order} == {r.name for r in RULES}


def test_edges(edge_docs, no_docs):
    assert judge(no_docs).count() == 0 and [r for r, _, _ in order_rules(no_docs)] == list(RULES)
    kept = keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert all(len((r.text or "").split()) >= 50 for r in kept.collect())
    assert kept.filter("doc_id = 12").count() == 1
