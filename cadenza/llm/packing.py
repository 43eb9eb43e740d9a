"""Op 7: best-fit-decreasing packing of tokenized documents.

Documents become pieces in one narrow Arrow pass; only the piece descriptions (about 40 bytes each)
are shuffled, never token ids. A full piece is a sequence by itself. The rest (at most one piece a
document) is dealt evenly into groups of about ``group_rows`` pieces, and each group is packed best-fit
decreasing; a segment tree over the remaining capacities finds the tightest open bin. Groups are
independent, so the cost of splitting is at most about one part-filled sequence a group.

Null text counts as empty (one piece: the separator alone). Repeated rows are packed once each. An
empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.runtime import materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Word encodings that a Python worker keeps at most (about 200 bytes each); later words are encoded anew.
CACHE_WORDS = 400_000
#: How byte-level vocabularies split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """Encodes text by a byte-level BPE file, caching the ids of space-separated words.

    Such a tokenizer splits before every single space, so ids of a text are the joined ids of its
    words with their leading space, unless a word ends in white space: then the text is encoded whole.
    Words of ASCII and letters go straight to the merge model; others through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.split = regex.compile(SPLIT).findall
        self.plain = regex.compile(r"[\t\n\x20-\x7e\p{L}]*").fullmatch
        self.letters = {b: ord(c) for b, c in enumerate(byte_letters())}
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, p: str) -> bytes:
        """Ids of a piece that is merged as one."""
        got = self.cache.get(p)
        if got is None:
            shown = "Ġ" + p[1:] if p.isascii() and p[0] == " " and p[1:].isalpha() else p.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.merge(shown)]).tobytes()
        return got

    def word(self, w: str) -> bytes:
        core = w[1:] if w[:1] == " " else w
        if core.isalpha():
            return self.part(w)
        if core[:-1].isalpha() and core[-1] in ".,":
            return self.part(w[:-1]) + self.part(w[-1])
        if "<|" in w or not self.plain(w):
            return self.whole(w)
        return b"".join(map(self.part, self.split(w)))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "\0" in text:
            return self.whole(text)
        words, cache = text.replace(" ", "\0 ").split("\0"), self.cache
        new = set(words).difference(cache)
        if any(w[-1:].isspace() for w in new):
            return self.whole(text)
        extra = {w: self.word(w) for w in new}
        if len(cache) + len(extra) <= CACHE_WORDS:
            cache.update(extra)
            return b"".join(map(cache.__getitem__, words))
        return b"".join([extra[w] if w in extra else cache[w] for w in words])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder for a Python worker, whatever tasks it runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the first one shorter if it doesn't divide."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer_path: str, size: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece of each document, whose ids are its text's and then end_id."""

    def run(batches):
        encoder = encoder_of(tokenizer_path)
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for at in range(0, len(ids), 256):
                rows = []
                for d, t in zip(ids[at : at + 256], texts.slice(at, 256).to_pylist(), strict=True):
                    buf = encoder.encode(t or "") + end
                    rows += [(d, k, s, n, zlib.crc32(buf[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(buf) // 4, size))]
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. tree[i] counts the open bins whose remaining capacity lies below node i."""
    leaves = 1 << size.bit_length()
    tree = [0] * (2 * leaves)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    room: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def count(capacity: int, by: int) -> None:
        i = capacity + leaves
        while i:
            tree[i] += by
            i >>= 1

    def tightest(need: int) -> int:
        """The least capacity >= need that has an open bin, or 0."""
        i = need + leaves
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - leaves
            i >>= 1
        return 0

    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        c = tightest(n)
        if c:
            b = open_bins[c].pop()
            count(c, -1)
        else:
            b, c = len(room), size
            room.append(size)
        bins[k], offsets[k] = b, size - c
        room[b] = c - n
        if c - n:
            open_bins[c - n].append(b)
            count(c - n, 1)
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, group_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    cut_up = materialise(pieces(docs, tokenizer_path, size, id_col, text_col), "pieces")
    part = cut_up.filter(F.col("length") < size)
    groups = max(1, -(-part.count() // group_rows))

    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), size)
        pdf["sequence_id"] = ((pdf["g"].to_numpy().astype(np.int64) << 32) | bins) * 2 + 1
        pdf["offset"] = offsets
        return pdf.drop(columns="g")

    packed = part.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")).groupBy("g").applyInPandas(run, PIECES + ", sequence_id long, offset long")
    full = cut_up.filter(F.col("length") == size).select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)
