"""Alignment of two tokenizers over a corpus, scored through inverted pair bitmaps."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import pin

# A segment numbers its documents from 0; it is closed at so many documents or
# postings (documents of a pair, over all pairs), whatever comes first.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 16, 2_000_000
# A bitmap of this many documents or more is kept as bits, else as a sorted array.
DENSE, BITS = 4096, 8192
# Characters of text taken at a time; pieces of text, and their characters,
# whose alignment a worker remembers at most.
SLICE, REMEMBERED, REMEMBERED_CHARS = 1 << 22, 200_000, 1 << 22
# Pieces encoded at a time; links of a group from which on ids that repeat in
# it are paired once, with their number.
JOINED, LARGE = 256, 1024

# Between two characters that are no white space, both tokenizers part the
# text before a single space, so what lies between such cuts is encoded once.
_CUT = re.compile("(?<=[^\\s\u180e\u200b\ufeff]) (?=[^\\s\u180e\u200b\ufeff])")
_INNER = re.compile("[^\\s\u180e\u200b\ufeff](?:.*[^\\s\u180e\u200b\ufeff])?\\Z", re.DOTALL)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    visible Latin-1 characters themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte = _byte_of()
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
                        for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()
                        for i, t in enumerate(names)]
        self.b_size, self.a_size = len(names), 1 + max(self.a_bytes)
        self.a_length = np.array([len(self.a_bytes.get(i, b"")) for i in range(self.a_size)])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        # Ids as text, with the mark behind them: within a group, at its end,
        # and for B at the end of a piece.
        self.a_text = np.array([f"{i}{mark}" for mark in ",|" for i in range(self.a_size)], dtype=object)
        self.b_text = np.array([f"{i}{mark}" for mark in ",;\n" for i in range(self.b_size)], dtype=object)
        # A piece with a space behind another character could reach over a cut.
        self.cut = not any(" " in t.decode("utf-8", "replace").lstrip(" ") for t in self.b_bytes)

    def encode(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """A's ids of space + piece and B's of the piece; None where their
        bytes are not those of space + piece."""
        for piece, a, b in zip(pieces, self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False),
                               self.b.encode(pieces, num_threads=1)):
            data, a = (" " + piece).encode(), a.ids
            right = b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))
            yield (a, b) if right else None


class Aligned(NamedTuple):
    """Pieces of text, one behind the other: a row a piece (tokens of A and of
    B, groups, links), its groups as text, and its pairs up to ``ends``."""
    rows: np.ndarray
    shown: list[bytes]
    ends: np.ndarray
    codes: np.ndarray
    times: np.ndarray


def aligned(a: np.ndarray, b: np.ndarray, piece_ends: np.ndarray, t: Tokenizers) -> Aligned:
    """The groups between byte offsets at which tokens of both end, for the
    ids of pieces that end at the byte offsets ``piece_ends`` (both tokenizers
    part there). A group links all its pairs."""
    ends_a, ends_b = np.cumsum(t.a_length[a]), np.cumsum(t.b_length[b])
    end_a, end_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    piece = np.searchsorted(piece_ends, ends_a[end_a])
    count = lambda values: _added(piece, values, len(piece_ends))
    rows = np.stack([count(n_a), count(n_b), count(np.ones_like(n_a)), count(n_a * n_b)], axis=1)

    # Each id with the mark behind it: A's and B's of a group, then the next group or piece.
    last = np.concatenate([piece[1:] != piece[:-1], [True]])
    texts = np.empty(len(a) + len(b), dtype=object)
    texts[np.arange(len(a)) + first_b[group_a]] = t.a_text[a + t.a_size * end_a]
    texts[np.arange(len(b)) + (first_a + n_a)[group_b]] = t.b_text[b + t.b_size * (end_b * (1 + last[group_b]))]
    shown = "".join(texts).encode().split(b"\n")[:-1]

    links = n_a * n_b
    large = links > LARGE
    times_a = np.where(large, 0, n_b)[group_a]
    at = np.arange(times_a.sum()) - np.repeat(np.cumsum(times_a) - times_a, times_a)
    codes = np.repeat(a * t.b_size, times_a) + b[at + np.repeat(first_b[group_a], times_a)]
    times, of = np.ones(len(codes), dtype=np.int64), np.repeat(piece[group_a], times_a)
    for g in np.flatnonzero(large):  # ids that repeat in a long group are paired once
        x, n = np.unique(a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
        y, m = np.unique(b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
        codes = np.concatenate([codes, (x[:, None] * t.b_size + y).ravel()])
        times = np.concatenate([times, (n[:, None] * m).ravel()])
        of = np.concatenate([of, np.full(len(x) * len(y), piece[g])])
    if large.any():
        order = np.argsort(of, kind="stable")
        codes, times, of = codes[order], times[order], of[order]
    return Aligned(rows, shown, np.searchsorted(of, np.arange(len(piece_ends)), side="right"), codes, times)


def _added(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, at, values)
    return out


class _Aligner:
    """Alignment of texts piece by piece; pieces seen before are remembered."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.tokenizers = Tokenizers(a_path, b_path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.chars = 0
        # A row a piece (right, tokens of A and of B, groups, links, end of its pairs).
        self.rows = np.empty((0, 6), dtype=np.int64)
        self.codes = self.times = np.empty(0, dtype=np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Pieces that start and end within words are encoded many at a time,
        joined by spaces, at which both tokenizers part; where the bytes of
        the whole are not right, and for other pieces, each by itself."""
        t, ids_a, ids_b, kept, odd = self.tokenizers, [], [], [], []
        plain = [p for p in pieces if _INNER.match(p)] if t.cut else []
        odd = [p for p in pieces if not (t.cut and _INNER.match(p))]
        for at in range(0, len(plain), JOINED):
            some = plain[at:at + JOINED]
            both = next(t.encode([" ".join(some)]))
            if both is None:
                odd += some
                continue
            ids_a += both[0]
            ids_b += both[1]
            kept += some
        wrong = []
        for piece, both in zip(odd, t.encode(odd)):
            if both is None:
                wrong.append(piece)
                continue
            ids_a += both[0]
            ids_b += both[1]
            kept.append(piece)
        for piece in kept + wrong:
            self.known[piece] = len(self.known)
            self.chars += len(piece)
        if kept:
            ends = np.cumsum([1 + len(p.encode()) for p in kept])
            new = aligned(np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64), ends, t)
            self.rows = np.concatenate([self.rows, np.column_stack(
                [np.ones(len(kept), dtype=np.int64), new.rows, new.ends + len(self.codes)])])
            self.shown += new.shown
            self.codes, self.times = np.concatenate([self.codes, new.codes]), np.concatenate([self.times, new.times])
        if wrong:
            none = np.zeros((len(wrong), 6), dtype=np.int64)
            none[:, 5] = len(self.codes)
            self.rows = np.concatenate([self.rows, none])
            self.shown += [b""] * len(wrong)

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """A row a text (n_a, n_b, n_groups, n_links, digest), and its pairs
        as (text's index, pair, links)."""
        parts = [(_CUT.split(t) if self.tokenizers.cut else [t]) if t else [] for t in texts]
        new = dict.fromkeys(p for part in parts for p in part if p not in self.known)
        self.learn(list(new))
        rows = self.rows
        out, docs, uses = [], [], []
        for k, part in enumerate(parts):
            at = np.fromiter(map(self.known.__getitem__, part), dtype=np.int64, count=len(part))
            if not len(at) or not rows[at, 0].all():
                out.append((0, 0, 0, 0, ""))
                continue
            digest = sha256(b";".join(map(self.shown.__getitem__, at.tolist()))).hexdigest()
            out.append((*rows[at, 1:5].sum(axis=0).tolist(), digest))
            docs.append(np.full(len(at), k))
            uses.append(at)
        none = np.empty(0, dtype=np.int64)
        doc, use = np.concatenate([none, *docs]), np.concatenate([none, *uses])
        both, times = np.unique(doc * len(rows) + use, return_counts=True)
        doc, use = both // max(1, len(rows)), both % max(1, len(rows))
        ends = rows[:, 5]
        first = np.concatenate([[0], ends])[use]
        count = ends[use] - first
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        doc = np.repeat(doc, count)
        code, n = self.codes[at], self.times[at] * np.repeat(times, count)
        doc, code, n = _summed(doc, code, n)
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        return out, doc, code, n


def _summed(doc: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, code, n) sorted by code and doc, n summed over equal ones."""
    order = np.argsort((code << 32) | doc)
    doc, code, n = doc[order], code[order], n[order]
    new = np.flatnonzero(np.concatenate([[len(doc) > 0], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])[:len(doc)])
    return doc[new], code[new], np.add.reduceat(n, new) if len(new) else n


def pack_bitmap(docs: np.ndarray) -> bytes:
    """Sorted numbers below 65,536 as 16-bit numbers, or as bits if many."""
    if len(docs) < DENSE:
        return docs.astype("<u2").tobytes()
    bits = np.zeros(8 * BITS, dtype=np.uint8)
    bits[docs] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bitmap(data: bytes) -> np.ndarray:
    if len(data) < BITS:
        return np.frombuffer(data, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little"))


def pair_planes(doc: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(pair, documents, links, planes) of a segment's postings: plane k is
    the bitmap of the documents whose number of links has bit k set, so the
    pair's documents are the planes' union, and its links are 2**k times each
    plane's popcount."""
    start = np.flatnonzero(np.concatenate([[len(code) > 0], code[1:] != code[:-1]])[:len(code)])
    end = np.append(start[1:], len(code))
    planes: list[list[bytes]] = [[] for _ in start]
    for k in range(int(n.max(initial=0)).bit_length()):
        has = (n >> k) & 1 == 1
        held, upto = doc[has], np.concatenate([[0], np.cumsum(has)])
        small = held.astype("<u2").tobytes()
        for plane, a, b in zip(planes, upto[start].tolist(), upto[end].tolist()):
            plane.append(small[2 * a:2 * b] if b - a < DENSE else pack_bitmap(held[a:b]))
    links = np.add.reduceat(n, start) if len(start) else n
    for pair, a, b, total, plane in zip(code[start].tolist(), start.tolist(), end.tolist(), links.tolist(), planes):
        while not plane[-1]:
            plane.pop()
        yield pair, b - a, total, plane


PARTS = ("segment long, number int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "code long, n_docs long, pair_links long, planes array<binary>")
_DOC = ["segment", "number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_ARROW = pa.schema([("segment", pa.int64()), ("number", pa.int32()), *[(c, pa.int64()) for c in _DOC[2:7]],
                    ("groups_sha256", pa.string()), ("code", pa.int64()), ("n_docs", pa.int64()), ("pair_links", pa.int64()),
                    ("planes", pa.list_(pa.binary()))])


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
                                       for f in _ARROW], schema=_ARROW)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about SLICE characters of text."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if held and held + len(text) > SLICE:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            held += len(text) + 100
    if ids:
        yield ids, texts


def _segments(a_path: str, b_path: str, docs_max: int, postings_max: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(a_path, b_path)
        segment, number, held = TaskContext.get().partitionId() << 32, 0, []

        def closed() -> Iterator[pa.RecordBatch]:
            merged = list(pair_planes(*_summed(*[np.concatenate(x) for x in zip(*held)]))) if held else []
            for at in range(0, len(merged), 20_000):
                part = merged[at:at + 20_000]
                yield _rows({"segment": [segment] * len(part), "code": [p[0] for p in part],
                             "n_docs": [p[1] for p in part], "pair_links": [p[2] for p in part],
                             "planes": [p[3] for p in part]})

        for ids, texts in _slices(batches):
            for at in range(0, len(ids), docs_max):
                some = ids[at:at + docs_max]
                if number + len(some) > docs_max or sum(len(h[0]) for h in held) > postings_max:
                    yield from closed()
                    segment, number, held = segment + 1, 0, []
                rows, doc, code, n = aligner.align(texts[at:at + docs_max])
                held.append((doc + number, code, n))
                yield _rows({"segment": [segment] * len(some), "number": list(range(number, number + len(some))),
                             "doc_id": some} | {c: [r[k] for r in rows] for k, c in enumerate(_DOC[3:])})
                number += len(some)
        yield from closed()
    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, planes, n, best) sorted by segment: each posting returns
    its pair's score to its document. One segment's sums are held at a time."""
    def flushed() -> pa.RecordBatch:
        at = np.flatnonzero(count_sum)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), last)), pa.array(at.astype(np.int32)),
                                           pa.array(n_best[at]), pa.array(count_sum[at])],
                                          ["segment", "number", "n_best", "count_sum"])

    last, n_best, count_sum = None, np.zeros(8 * BITS, np.int64), np.zeros(8 * BITS, np.int64)
    for batch in batches:
        segment, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        best = batch.column(3).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(segment)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(segment)]):
            if a == b:
                continue
            if last is not None and segment[a] != last:
                yield flushed()
                n_best[:], count_sum[:] = 0, 0
            last = segment[a]
            planes = batch.column(1).slice(a, b - a)
            per = planes.value_lengths().to_numpy()
            row = np.repeat(np.arange(a, b), per)
            links = np.int64(1) << (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
            data = planes.flatten().to_pylist()
            size = np.array([len(d) for d in data])
            few = size < BITS
            number = np.frombuffer(b"".join(d for d in data if len(d) < BITS), dtype="<u2")
            row_few, links_few = np.repeat(row[few], size[few] // 2), np.repeat(links[few], size[few] // 2)
            np.add.at(count_sum, number, links_few * n[row_few])
            np.add.at(n_best, number, links_few * best[row_few])
            for k in np.flatnonzero(~few):
                at = unpack_bitmap(data[k])
                count_sum[at] += links[k] * n[row[k]]
                n_best[at] += links[k] * int(best[row[k]])
    if last is not None:
        yield flushed()


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, b_size: int, id_col: str = "doc_id", text_col: str = "text",
                     segment_docs: int = SEGMENT_DOCS, segment_postings: int = SEGMENT_POSTINGS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of two tokenizers over ``docs``.

    documents, one row per row of ``docs``: doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256; pairs: a_id, b_id, n_docs (how
    many documents hold the pair linked), n_links, best (n_docs is the A id's
    highest). ``a_path`` is a byte-level BPE, ``b_path`` a piece model with
    ``b_size`` pieces. Text is encoded as space + text, without special tokens.

    1. One pass over the texts aligns each and keeps, for a segment of at most
       ``segment_docs`` documents, a compressed bitmap of documents for each
       id pair, with a plane for each bit of the number of links. Slices of a
       segment are merged before it is written.
    2. Popcounts are summed over segments, map-side first, to a pair's
       document count; an A id's highest count marks its best pairs.
    3. The pairs' scores go to the segments, where each posting adds its
       pair's score to its document. A pair has at most one row a segment,
       so a pair that all documents hold is spread as they are.

    Defined results: null or empty texts, and texts whose tokens' bytes are
    not space + text in either tokenizer, have no tokens: zeros and an empty
    groups_sha256. Rows with null or repeated ids are documents of their own;
    an empty table gives empty tables; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = pin(texts.mapInArrow(_segments(a_path, b_path, min(segment_docs, SEGMENT_DOCS), segment_postings), PARTS),
                "alignment-segments")
    rows, postings = parts.filter("code is null").select(*_DOC), parts.filter("code is not null")
    counts = postings.groupBy("code").agg(F.sum("n_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
    counts = counts.withColumn("a_id", F.expr(f"code div {int(b_size)}"))
    highest = counts.groupBy("a_id").agg(F.max("n_docs").alias("highest"))
    pairs = pin(counts.join(highest, "a_id").select(
        "code", "a_id", (F.col("code") % int(b_size)).alias("b_id"), "n_docs", "n_links",
        (F.col("n_docs") == F.col("highest")).alias("best")), "alignment-pairs")
    scored = postings.select("segment", "code", "planes").join(pairs.select("code", "n_docs", "best"), "code")
    dealt = scored.select("segment", "planes", "n_docs", "best").repartition("segment").sortWithinPartitions("segment")
    sums = dealt.mapInArrow(_scores, "segment long, number int, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    documents = rows.join(sums, ["segment", "number"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    return documents, pairs.drop("code")

