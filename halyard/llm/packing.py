"""Packing token sequences: first-fit decreasing with a tournament tree of bin
capacities, run independently in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import pin

SEQ_LEN = 2048
END_ID = 1
# Pieces in one packing group, about.
GROUP_PIECES = 4096
# Spelled words, and stems, whose ids a Python worker remembers at most.
CACHE_WORDS, CACHE_STEMS = 400_000, 600_000
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary spells each byte: printable
    Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """word (UTF-8) -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer never joins across white space, so a text's ids are its
    words' ids in a row, and each distinct word is looked up once a worker. It
    also parts letters from punctuation and ignores case, so a word made of
    letters and trailing punctuation (no apostrophe: "'s" is one token) has
    the ids of its lower-case letters, then those of the punctuation, if it is
    of letters only after normalizing, too (not so "\u0130", a letter and a mark). Stems
    of Latin-1 letters, which need no more normalizing, go straight to the
    tokenizer's model, a byte a letter; everything else goes through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.letters = dict(enumerate(_byte_letters()))
        self.stems: dict[str, bytes] = {}

    def _stem(self, word: str, plain: bool = False) -> bytes:
        out = self.stems.get(word)
        if out is None:
            if plain:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(spelled)]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            self.stems[word] = out = np.asarray(ids, dtype="<u4").tobytes()
        return out

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8")
        stem = word.rstrip(_PUNCTUATION)
        # Below U+0100 lower case is one letter for one, as in the tokenizer.
        plain = stem.isalpha() and max(stem) < "\u0100"
        if not plain and not (stem.isalpha() and self.normalize(stem).isalpha()):
            out = self._stem(word)
        else:
            out = self._stem(stem.lower() if plain else stem, plain) + (self._stem(word[len(stem):]) if len(stem) < len(word) else b"")
        self[raw] = out
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.stems) > CACHE_STEMS:
            self.stems.clear()
        # bytes.split() parts at the white space of WORD
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


_CACHES: dict[str, _Words] = {}


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
               seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``seq_len`` ids: doc_id, start, length,
    ids_crc32, doc_tokens (and ids, binary, if asked for). A document is its
    text's ids and one end id; a null or empty text has the end id alone."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _CACHES[tokenizer] if tokenizer in _CACHES else _CACHES.setdefault(tokenizer, _Words(tokenizer))
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = words.encode(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, seq_len):
                    piece = ids[4 * start:4 * (start + seq_len)]
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, piece)[:5 + with_ids])
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInPandas(run, schema)


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; ``lengths`` must not increase.

    The leaves of the tree are the bins' free room and each inner node is the
    larger of its two; walking down to the left wherever the item still fits
    finds the first bin in O(log n).
    """
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        out.append((node - leaves, capacity - room[node]))
        room[node] -= n
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return out


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Pieces are numbered and dealt by a hash of the number, so that null and
    repeated ids are spread like others, into groups of about
    ``group_pieces``, and each group is packed by itself in one task, so work
    and memory of a task stay the same at any size. Groups of some thousand
    pieces leave hardly more padding than one packing of all would. Ties in
    length go by (doc_id, start). A sequence id is its group's number times
    2**32 plus its number in the group.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    pieces = pin(pieces.withColumn("pack_row", F.monotonically_increasing_id()), "pack-pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    group = F.pmod(F.xxhash64("pack_row"), F.lit(groups)).cast("bigint")
    dealt = pieces.withColumn("pack_group", group).drop("pack_row")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        where = first_fit_decreasing(pdf["length"].tolist(), seq_len)
        return pdf.drop(columns="pack_group").assign(
            sequence_id=[(int(key[0]) << 32) + b for b, _ in where], offset=[o for _, o in where])

    return dealt.groupBy("pack_group").applyInPandas(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Tokenize, cut and pack whole documents: one row per piece.

    Defined results: a null id is a document of its own row; repeated rows are
    packed each; an empty table gives an empty table; input columns other than
    id and text are not looked at.
    """
    return pack(cut_pieces(docs, tokenizer, **options))


def sequences(packed: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """sequence_id and its ``seq_len`` ids (binary, zero padded) from pieces
    packed with their ids; a sequence has at most ``seq_len`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids")).select(
        "sequence_id", F.rpad("ids", 4 * seq_len, F.lit(b"\x00")).alias("ids"))
