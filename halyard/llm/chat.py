"""Incremental black-box chat rendering: prefixes of a conversation are
rendered and consecutive outputs compared to find each turn's span."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import runs

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

# The production template's control strings contain "<"; inside texts it is
# always spelled "\l", so no text can hold one of them.
_ESCAPES = {"\\": "\\\\", "<": "\\l"}
_ROLE_ESCAPES = {**_ESCAPES, ">": "\\g", "\n": "\\n"}


def _escape(s: str, table: dict[str, str]) -> str:
    for c, spelled in table.items():  # the backslash is first, and no spelling holds a later character
        s = s.replace(c, spelled)
    return s


def unescape(s: str) -> str:
    """The text that ``turn_template`` wrote as ``s``."""
    if "\\" not in s:
        return s
    back, out, i = {v[1]: k for k, v in _ROLE_ESCAPES.items()}, [], 0
    while i < len(s):
        if s[i] == "\\":
            out.append(back[s[i + 1]])
            i += 2
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def turn_template(turns: list[Turn]) -> str:
    """<turn ROLE>, the escaped text and </turn>, each on its own line."""
    return "".join(f"<turn {_escape(role, _ROLE_ESCAPES)}>\n{_escape(text, _ESCAPES)}\n</turn>\n"
                   for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a ``turn_template`` output, read back from it alone."""
    out, at = [], 0
    while at < len(formatted):
        head = formatted.index(">\n", at)
        end = formatted.index("\n</turn>\n", head + 1)
        out.append((unescape(formatted[at + len("<turn "):head]), unescape(formatted[head + 2:end])))
        at = end + len("\n</turn>\n")
    return out


class Span(NamedTuple):
    """Offsets (code points) of a turn and of its text in the output."""

    role: str
    start: int
    end: int
    text_start: int
    text_end: int


def _same_start(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[Span] | None]:
    """The rendered conversation and the span of each turn in it, or None if
    the template rewrites what it wrote for earlier turns.

    Render the first 0, 1, 2, ... turns. Whatever the outputs agree on beyond
    a tail of fixed length is history; a template whose output for k turns
    isn't, without that one constant tail (end marks, a generation prompt),
    the beginning of its output for k + 1 turns rewrites history. A turn's
    span is what its step added. Its text lies in there between the header
    and the footer, whose lengths come from two renderings of the turn with
    one-letter texts that differ. Only two prefixes are held at a time.
    """
    out = start = template([])
    spans, tail, ends = [], 0, {start}
    for k, (role, text) in enumerate(turns):
        before, out = out, template(turns[:k + 1])
        tail = max(tail, len(before) - _same_start(before, out))
        ends.add(out[-len(start):] if start else "")  # no tail is longer than what no turns render to
        a, b = (template([*turns[:k], (role, x)]) for x in "ab")
        head = _same_start(a, b)
        foot = len(a) - head - 1
        if len(a) != len(b) or a[head + 1:] != b[head + 1:] or not out.startswith(a[:head]):
            return template(turns), None  # the text shapes what stands around it
        spans.append(Span(role, len(before), len(out), head, len(out) - foot))
    if tail > len(start) or len({e[len(e) - tail:] for e in ends if len(e) >= tail}) > 1 or any(len(e) < tail for e in ends):
        return out, None
    return out, [s._replace(start=s.start - tail, end=s.end - tail) for s in spans]


FORMATTED = ("conv_id long, n_turns long, formatted string, rewrites_history boolean, "
             "spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long>>")
# Conversations, and characters of them, that are handed to Spark at a time, about.
BATCH_ROWS, BATCH_CHARS = 500, 4 << 20


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "formatted", "rewrites_history", "spans"])
    return frame.assign(conv_id=[None if pd.isna(x) else int(x) for x in frame["conv_id"]]).astype({"conv_id": "Int64"})


def format_conversations(conversations: DataFrame, template: Template = turn_template) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, rewrites_history,
    spans (null if the template rewrites history).

    Rows (conv_id, turn, role, text) are dealt by conv_id, sorted by turn
    inside a partition and rendered one conversation at a time, so a task
    holds a conversation and a batch of outputs, not a partition's.

    Defined results: null texts and roles are empty; a null conv_id is one
    conversation; null turns come first; rows of one turn go by role, then
    text; repeated rows are turns of their own; an empty table gives an empty
    table; other columns are ignored.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, chars = [], 0
        for pdf in runs(batches, ["conv_id"]):
            turns = list(zip(pdf["role"].tolist(), pdf["text"].tolist()))
            formatted, spans = locate(template, turns)
            done.append((pdf["conv_id"].iloc[0], len(turns), formatted, spans is None, spans and [s._asdict() for s in spans]))
            chars += len(formatted)
            if len(done) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield _frame(done)
                done, chars = [], 0
        if done:
            yield _frame(done)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", empty("role"), empty("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInPandas(run, FORMATTED))
