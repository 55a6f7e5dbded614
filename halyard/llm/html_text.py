"""Main text of web pages with a suffix array over each host's tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import WORD, pin, runs

# Shortest run of tokens that counts as repeated, and tokens of one suffix array, about.
MIN_TOKENS = 6
ARRAY_TOKENS = 200_000
# Distinct pages of a host that must share what counts as its boilerplate.
MIN_PAGES = 3

# What HTML elements are.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
           "sub", "sup", "time", "tt", "u", "var", "wbr",
           "math", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot",
           "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics"}
_UNSEEN = {"script", "style", "template", "noscript", "head", "title", "svg", "annotation", "annotation-xml", "iframe",
           "object", "canvas", "audio", "video", "select", "textarea", "button"}
_CHROME = {"nav", "header", "footer", "aside", "dialog", "menu"}
_MAIN = {"article", "main"}
_CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "pagination", "popup", "promo", "recommended", "related", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "teaser", "teasers", "toolbar", "widget", "widgets"}
# What the furniture of a compound name may be made of besides: "share-buttons",
# "site-footer", "comment-12". Any other part ("no-sidebar", "footer-style") and
# the name is not one of furniture.
_PART_WORDS = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "global",
    "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "outer", "page", "panel",
    "post", "posts", "primary", "right", "secondary", "section", "signup", "site", "slot", "text", "thread", "title", "top",
    "unit", "wrap", "wrapper"}
# What may stand in the head of a page; any other element ends it.
_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
# These name page furniture only outside an article, which has a header of its own.
_OUTER_WORDS = {"header", "masthead", "top"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}
_SPACE = re.compile("[ \t-\r]+")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)

FREE, MAIN, CHROME = 0, 1, 2


def _names_chrome(name: str) -> bool:
    """Whether a whole class name or id names furniture: a word for it, alone
    or in a compound of such words, neutral ones and numbers."""
    parts = [p for p in re.split("[_-]+", name) if p]
    return (not _CHROME_WORDS.isdisjoint(parts)
            and all(p in _CHROME_WORDS or p in _PART_WORDS or p.isdigit() for p in parts))


class _Open(NamedTuple):
    """An open element: the kind of its text, whether it is unseen, furniture
    around it, its box (the outermost form or the like around it, of which
    its text decides), whether an article is around it, and the place in the
    stack of the nearest element that is not inline, itself or below."""
    tag: str
    kind: int
    unseen: bool
    depth: int
    box: int
    in_main: bool
    block: int


class _Blocks(HTMLParser):
    """The blocks of a page in order: (kind, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.raw: list[tuple[int, int, int, str]] = []  # kind, furniture around its article, box, text
        self.stack: list[_Open] = []
        self.opened: Counter[str] = Counter()  # open elements by name
        self.held: list[str] = []
        self.boxes = 0

    def _state(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", FREE, False, 0, 0, False, -1)

    def _drop(self, at: int) -> None:
        """Close the open elements from place ``at`` on."""
        self.opened.subtract(e.tag for e in self.stack[at:])
        del self.stack[at:]

    def _cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.held)).strip(" ")
        if text:
            top = self._state()
            self.raw.append((top.kind, top.depth, top.box, text))
        self.held = []

    def blocks(self) -> list[tuple[int, str]]:
        """A box that holds most of the text around it is a plain container,
        else furniture; of articles those with the least furniture around."""
        total, inside = {FREE: 0, MAIN: 0}, {}
        for kind, _, box, text in self.raw:
            if kind != CHROME:
                total[kind] += len(text)
                inside[kind, box] = inside.get((kind, box), 0) + len(text)
        total[FREE] += total[MAIN]
        closed = {(kind, box) for (kind, box), n in inside.items() if box and 2 * n <= total[kind]}
        seen = [(CHROME if (kind, box) in closed else kind, depth, text) for kind, depth, box, text in self.raw]
        least = min((depth for kind, depth, _ in seen if kind == MAIN), default=0)
        return [(CHROME if kind == MAIN and depth > least else kind, text) for kind, depth, text in seen]

    def _end_head(self) -> None:
        """The end tag of a head is optional: what can't be in it ends it."""
        if self.opened["head"]:
            at = next(i for i, e in enumerate(self.stack) if e.tag == "head")
            if len(self.stack) == at + 1 or self.stack[at + 1].tag not in _HEAD:
                self._cut()
                self._drop(at)

    def handle_starttag(self, tag, attrs):
        if tag not in _HEAD and tag != "head":
            self._end_head()
        if tag in _VOID:
            if tag not in _INLINE:
                self._cut()
            return
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):  # an open one of these ends here
            self._close_implied(tag)
        top = self._state()
        kind, depth, box = top.kind, top.depth, top.box
        if tag not in _INLINE:
            self._cut()
        values = {k: v or "" for k, v in attrs}
        role = values.get("role", "").lower()
        article = tag in _MAIN or role in ("main", "article")
        named = f'{values.get("class", "")} {values.get("id", "")}'.lower().split()
        chrome = (tag in _CHROME and not (tag == "header" and top.in_main) or role in _CHROME_ROLES
                  or tag not in ("html", "body") and any(map(_names_chrome, named))
                  or "hidden" in values or values.get("aria-hidden") == "true"
                  or "style" in values and _UNSHOWN.search(values["style"]) is not None)
        boxed = (tag == "form" or role == "form"
                 or tag not in ("html", "body") and not top.in_main and not _OUTER_WORDS.isdisjoint(named))
        if chrome:
            depth += 1
        if article:
            kind, box = MAIN, 0
        elif kind != CHROME:
            if chrome:
                self._cut()
                kind = CHROME
            elif boxed and not box:
                self._cut()
                self.boxes += 1
                box = self.boxes
        block = top.block if tag in _INLINE else len(self.stack)
        self.stack.append(_Open(tag, kind, top.unseen or tag in _UNSEEN, depth, box, top.in_main or kind == MAIN, block))
        self.opened[tag] += 1

    def _close_implied(self, tag):
        mates = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
        at = self._state().block if any(self.opened[m] for m in mates) else -1
        while at >= 0:
            name = self.stack[at].tag
            if name in mates:
                self._cut()
                self._drop(at)
                return
            if name != "p":
                return
            at = self.stack[at - 1].block if at else -1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.stack and self.stack[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.opened[tag]:
            at = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag)
            own = self._state()
            if any(e.tag not in _INLINE or (e.kind, e.box) != (own.kind, own.box) for e in self.stack[at:]):
                self._cut()
            self._drop(at)
        elif tag not in _INLINE:  # a stray end tag still ends a block
            self._cut()

    def handle_data(self, data):
        if self.stack and self.stack[-1].tag == "head" and not data.isspace():
            self._end_head()
        if not self._state().unseen:
            self.held.append(data)


def page_blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block of text: MAIN inside an article or main
    element, CHROME inside what is marked as page furniture, else FREE.
    Scripts, styles and the like have no text, nor does what is styled not to
    be displayed; a head ends, with or without its end tag, where anything
    else begins. Asides and footers are furniture inside an article as well,
    its header is not. Articles side by side all count. An article inside furniture is
    MAIN if none has less furniture around it (a page wrapped in a "sidebar";
    comments that are articles of their own are not). Forms, and outside an
    article elements named header or top, are furniture only if they hold no
    more than half of the text, and never for an article inside them."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._cut()
    return parser.blocks()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for html in pdf["html"]:
            blocks = page_blocks(html)
            out.append((any(k == MAIN for k, _ in blocks), " ".join(t for k, t in blocks if k == MAIN),
                        [{"kind": k, "text": t} for k, t in blocks if k != MAIN]))
        yield pdf.drop(columns="html").assign(**dict(zip(("has_main", "main", "around"), map(list, zip(*out)))))


def _ranks(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``tokens`` sorted to ``depth`` tokens, by prefix
    doubling, and each suffix's rank; equal ranks share ``depth`` tokens."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.full(len(rank), -1, dtype=np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return np.argsort(rank, kind="stable"), rank


def repeated_tokens(pages: list[list[int]], depth: int, least: int = 2) -> list[np.ndarray]:
    """Per page a mask of the tokens inside a run of ``depth`` or more tokens
    that at least ``least`` pages have.

    The pages' tokens are joined, each page closed by a token of its own. In
    suffix order, neighbours of equal rank share ``depth`` tokens; a rank whose
    suffixes start in so many pages is a repeated run, and every longer
    repeated substring is a chain of such runs.
    """
    lengths = np.array([len(p) for p in pages], dtype=np.int64)
    joined = np.concatenate([np.append(np.asarray(p, dtype=np.int64), -1 - i) for i, p in enumerate(pages)])
    owner = np.repeat(np.arange(len(pages)), lengths + 1)
    covered = np.zeros(len(joined), dtype=bool)
    if len(joined) > 1:
        order, rank = _ranks(joined, depth)
        # owners ascend within a rank, as the sort is stable
        change = (rank[order][1:] != rank[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        first = order[np.concatenate([[True], change])]  # one suffix of each (rank, page)
        hits = np.flatnonzero((np.bincount(rank[first], minlength=rank.max() + 1) >= least)[rank])
        for k in range(depth):
            covered[np.minimum(hits + k, len(joined) - 1)] = True
    ends = np.cumsum(lengths + 1)
    return [covered[e - n - 1:e - 1] for e, n in zip(ends, lengths)]


def _token_ids(text: str) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(t) >> 2 for t in text.encode("utf-8", "replace").split()]


def _grams(ids: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit hash of each run of ``depth`` tokens."""
    out = np.zeros(max(0, len(ids) - depth + 1), dtype=np.uint64)
    for k in range(depth):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + len(out)].astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out


def _cover(depth: int, least: int):
    """One suffix array per host: the positions it covers in each page."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["host"]):
            masks = repeated_tokens([_token_ids(t) for t in pdf["stream"]], depth, least)
            yield pd.DataFrame({"row": pdf["row"], "covered": [np.flatnonzero(m).tolist() for m in masks]})
    return run


def _part_runs(depth: int):
    """One suffix array per (host, part): the hash of each run of ``depth``
    tokens, and how many of the part's pages have it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["host", "part"]):
            grams = [np.unique(_grams(np.asarray(_token_ids(t), dtype=np.int64), depth)) for t in pdf["stream"]]
            gram, n = np.unique(np.concatenate([np.empty(0, np.uint64), *grams]), return_counts=True)
            yield pd.DataFrame({"host": pdf["host"].iloc[0], "gram": gram.view(np.int64), "n": n})
    return run


def _emit_grams(depth: int):
    """The position and hash of every run of ``depth`` tokens."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for host, part, row, stream in zip(pdf["host"], pdf["part"], pdf["row"], pdf["stream"]):
                grams = _grams(np.asarray(_token_ids(stream), dtype=np.int64), depth)
                yield pd.DataFrame({"host": host, "part": part, "row": row, "pos": np.arange(len(grams), dtype=np.int32),
                                    "gram": grams.view(np.int64)})
    return run


def covered_tokens(streams: DataFrame, min_tokens: int = MIN_TOKENS, array_tokens: int = ARRAY_TOKENS,
                   min_pages: int = 2) -> DataFrame:
    """(row, covered): positions of the tokens of each stream (row, host,
    stream) that lie in a run of ``min_tokens`` or more that at least
    ``min_pages`` rows of the host have; rows without any may be missing.

    A host of more than ``array_tokens`` tokens is split into parts by row
    hash. Parts count the pages of each of their runs, by its hash; Spark adds
    the counts of a host, and the tokens of runs that enough pages have are
    covered. So the outcome is that of one array over the whole host, while
    no task holds more than a part.
    """
    sized = streams.withColumn("n", F.regexp_count("stream", F.lit(WORD)))
    hosts = pin(sized.groupBy("host").agg(F.ceil(F.sum("n") / array_tokens).alias("parts")), "html-hosts")
    dealt = sized.join(hosts, "host").select(
        "host", F.pmod(F.xxhash64("row"), F.greatest("parts", F.lit(1))).alias("part"), "parts", "row", "stream")
    covered = (dealt.filter("parts <= 1").select("host", "row", "stream").repartition("host").sortWithinPartitions("host", "row")
               .mapInPandas(_cover(min_tokens, min_pages), "row long, covered array<int>"))
    if not hosts.filter("parts > 1").take(1):
        return covered
    large = dealt.filter("parts > 1").select("host", "part", "row", "stream")
    counts = large.repartition("host", "part").sortWithinPartitions("host", "part").mapInPandas(
        _part_runs(min_tokens), "host string, gram long, n long")
    shared = counts.groupBy("host", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_pages).select("host", "gram")
    grams = large.mapInPandas(_emit_grams(min_tokens), "host string, part long, row long, pos int, gram long")
    across = (grams.join(shared, ["host", "gram"])
              .select("row", F.explode(F.sequence("pos", F.col("pos") + (min_tokens - 1))).alias("at"))
              .groupBy("row").agg(F.collect_set("at").alias("covered")))
    return covered.unionByName(across)


def _unique_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for around, covered in zip(pdf["around"], pdf["covered"]):
            gone, at, left = set() if covered is None else set(covered), 0, []
            for block in around:
                n = sum(1 for w in _SPACE.split(block["text"]) if w)
                if block["kind"] == FREE and not gone.issuperset(range(at, at + n)):
                    left.append(block["text"])
                at += n
            out.append(" ".join(left))
        yield pdf[["page_id", "url"]].assign(text=out)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_tokens: int = MIN_TOKENS, array_tokens: int = ARRAY_TOKENS, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A page is cut into blocks. Text inside an article or main element, without
    menus, adverts, forms, comments and other marked furniture, is the main
    text. On a page without such an element the unmarked blocks are, less the
    boilerplate of its host: blocks that lie as a whole in runs of
    ``min_tokens`` or more tokens which at least ``min_pages`` distinct pages
    of the host repeat, found by a suffix array over the host's token streams.
    Pages with equal streams (copies) count as one page, and a quotation that
    is part of a block stays. Text inside an article is never removed for
    being repeated: pages also carry copies of each other's articles, and
    repetition can't tell those from boilerplate.

    Defined results: null html or html without text gives an empty text; a null
    url is a host of its own; repeated pages are rows of their own with the
    same text; an empty table gives an empty table; clashing extra columns are
    ignored.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    parsed = rows.mapInPandas(_parse, "page_id long, url string, has_main boolean, main string, "
                                      "around array<struct<kind:int,text:string>>")
    parsed = pin(parsed.withColumn("row", F.monotonically_increasing_id()), "html-blocks")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    streams = parsed.select("row", host.alias("host"), F.array_join("around.text", " ").alias("stream"))
    # Of pages with equal streams one stands for all.
    same = streams.select("row", "host", F.md5("stream").alias("said"))
    copies = pin(same.join(same.groupBy("host", "said").agg(F.min("row").alias("first")), ["host", "said"]).select("row", "first"),
                 "html-copies")
    distinct = streams.join(copies.filter("row = first").select("row"), "row", "left_semi")
    covered = covered_tokens(distinct, min_tokens, array_tokens, min_pages).withColumnRenamed("row", "first")
    bare = parsed.filter(~F.col("has_main"))
    cut = (bare.select("row", "page_id", "url", "around").join(copies, "row").join(covered, "first", "left")
           .select("page_id", "url", "around", "covered").mapInPandas(_unique_blocks, "page_id long, url string, text string"))
    out = parsed.filter("has_main").select("page_id", "url", F.col("main").alias("text")).unionByName(cut)
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
