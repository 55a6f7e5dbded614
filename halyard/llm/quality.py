"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000
_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


class View:
    """A text whose measures are computed when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "replace").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in _SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in _SYMBOLS)

    @cached_property
    def line_counts(self) -> tuple[int, int]:
        """Lines with a word, and how many of them equal an earlier one."""
        lines = [x for x in self.text.split("\n") if x.strip(_SPACES)]
        return len(lines), len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows found twice or more, the first included."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        counts, mark = Counter(windows), bytearray(len(w))
        for i, x in enumerate(windows):
            if counts[x] > 1:
                mark[i] = mark[i + 1] = mark[i + 2] = 1
        return sum(mark)


@dataclass(frozen=True)
class Rule:
    """``rejects(view)`` says whether the rule turns a text down."""

    name: str
    rejects: Callable[[View], bool]


def too_few_words(v: View) -> bool:
    return v.n_words < 50


def repeated_windows(v: View) -> bool:
    return 100 * v.n_repeat_words > 50 * v.n_words


def too_many_symbols(v: View) -> bool:
    return 10 * v.n_symbols > v.n_words


def duplicate_lines(v: View) -> bool:
    return 2 * v.line_counts[1] > v.line_counts[0]


def odd_word_length(v: View) -> bool:
    return not 2 * v.n_words <= v.word_chars <= 15 * v.n_words


RULES = (Rule("repeated_windows", repeated_windows), Rule("duplicate_lines", duplicate_lines),
         Rule("odd_word_length", odd_word_length), Rule("too_many_symbols", too_many_symbols),
         Rule("too_few_words", too_few_words))


def _probe(rules: Sequence[Rule]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                mask, spent = 0, []
                for k, rule in enumerate(rules):
                    began = time.thread_time_ns()
                    mask |= rule.rejects(View(text)) << k  # a view of its own: the whole cost of the rule
                    spent.append(time.thread_time_ns() - began)
                out.append((mask, spent))
            yield pd.DataFrame(out, columns=["mask", "spent"])
    return run


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
                sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[Rule, float, int]]:
    """The rules in cascade order, each with its mean cost in ns and the
    sampled rows that it newly rejects there.

    A random sample of about ``sample_rows`` rows is run through every rule.
    Spark sums CPU time and counts each combination of rejecting rules (at
    most 2 ** len(rules) rows reach the driver). The next rule is always the
    one that rejects most of what is still in per unit of cost; rules that
    reject nothing there follow by cost. The order never changes the verdict,
    only the work. An empty table leaves the order as given.
    """
    n = docs.count()
    if not n:
        return [(r, 0.0, 0) for r in rules]
    share = min(1.0, 1.2 * sample_rows / n)
    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(fraction=share, seed=seed)
    seen = (sample.mapInPandas(_probe(rules), "mask long, spent array<long>")
            .groupBy("mask").agg(F.count(F.lit(1)).alias("n"),
                                 *[F.sum(F.col("spent")[k]).alias(f"ns{k}") for k in range(len(rules))])
            .collect())
    total = sum(r["n"] for r in seen) or 1
    cost = [max(1.0, sum(r[f"ns{k}"] for r in seen) / total) for k in range(len(rules))]
    left, masks, order = list(range(len(rules))), {r["mask"]: r["n"] for r in seen}, []
    while left:
        gain = {k: sum(c for m, c in masks.items() if m >> k & 1) for k in left}
        best = max(left, key=lambda k: (gain[k] / cost[k], -cost[k]))
        order.append((rules[best], cost[best], gain[best]))
        masks = {m: c for m, c in masks.items() if not m >> best & 1}
        left.remove(best)
    return order


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = "kept boolean, failed_rule string, rules_run int"


def cascade(order: Sequence[Rule], measures: bool = False) -> Callable[[Column], Column]:
    """A column function: the verdict struct of a text column.

    Rules run in ``order`` and stop at the first that rejects (failed_rule;
    null if kept); rules_run counts those that ran. With ``measures`` the
    struct also has every measure of the whole text, whatever was rejected.
    """
    schema = VERDICT + "".join(f", {m} long" for m in MEASURES) * measures

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                view, failed, k = View(text), None, 0
                for k, rule in enumerate(order, 1):
                    if rule.rejects(view):
                        failed = rule.name
                        break
                row = (failed is None, failed, k)
                if measures:
                    row += (view.n_words, view.word_chars, view.n_symbols, view.line_counts[1], view.n_repeat_words)
                out.append(row)
            yield pd.DataFrame(out, columns=["kept", "failed_rule", "rules_run", *MEASURES[:len(MEASURES) * measures]])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)


def judge(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, measures: bool = False,
          as_col: str = "verdict") -> DataFrame:
    """``docs`` with a verdict struct column from the cascade.

    Every whole text is judged. A null or empty text has no words and is
    rejected; ties and repeated rows get equal verdicts; an empty table stays
    empty; other columns pass through untouched (``as_col`` must be new).
    """
    order = [r for r, _, _ in order_rules(docs, rules, text_col)]
    return docs.withColumn(as_col, cascade(order, measures)(F.col(text_col).cast("string")))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` without the rows that the cascade rejects."""
    from halyard.llm.common import fresh

    v = fresh(docs, "quality_verdict")
    return judge(docs, text_col, rules, as_col=v).filter(F.col(v)["kept"]).drop(v)
