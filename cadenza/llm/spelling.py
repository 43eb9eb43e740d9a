"""Op 11: groups of spelling variants by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced letter turns one into the other. The vocabulary is
counted with map-side combine. Then each word generates its edits, as hashes only: every deletion, and every
replacement by a larger letter (so each pair is met from one side, the longer or the smaller word). A Python
worker probes them against a blocked Bloom filter, sharded by length, which is broadcast. Only edits that the
filter knows are written out and shuffled to a join with the vocabulary on the word itself, which removes the
filter's false positives.

A filter block is one 64-bit number of at most two words on average. At most ``BLOCKS`` blocks are built and
broadcast at a time: shards of a larger vocabulary (by length, and within a length by hash) take turns, so the
broadcast and what the driver holds have one bound at every size and no edit goes unprobed.

A word's form is the most frequent near word (ties: the smallest in code-point order) that is ``times`` as
frequent at least. Forms lead to ever more frequent words, so the root is found by doubling pointers.

Null text has no words. A null doc_id is written as nothing before the colon. Repeated rows count each. Extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ascii_lower
from cadenza.runtime import materialise

#: 64-bit blocks of the filters that are broadcast at once (8 MiB), words a block, and bits that a word sets in its block.
BLOCKS, LOAD, BITS = 1 << 20, 2, 5
#: Fixed value: the letters of which words are made.
LETTERS = r"A-Za-zÀ-ÿ"
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): runs of letters, lower-cased for A-Z; where ``every`` divides the crc32 of id and run, one letter of the run is left out."""
    # shorter runs never make a word, and a long run is matched whole
    runs = F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    x = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    x = x.select("id", F.when(ascii_only, F.lower("run")).otherwise(ascii_lower(F.col("run"))).alias("w"))
    x = x.select("w", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    left_out = F.concat(F.substring("w", F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    words = x.select(F.when(F.col("h") % every == 0, left_out).otherwise(F.col("w")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE))))


def word_hash(codes: np.ndarray) -> np.ndarray:
    """The sum of code * BASE ** place for each row of words of one length (before mixing)."""
    return (codes * _powers(codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def deletion_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length without the letter at each place (row, place)."""
    n, length = codes.shape
    power = _powers(length)
    terms = codes * power[:length]
    head = np.cumsum(terms, axis=1)  # up to each place, itself included
    # without place i, what stood behind it stands one place earlier
    tail = np.zeros((n, length), np.uint64)
    tail[:, :-1] = np.cumsum((codes[:, 1:] * power[: length - 1])[:, ::-1], axis=1)[:, ::-1]
    return head - terms + tail


def replacement_hashes(codes: np.ndarray, alphabet: np.ndarray, size: int = 1 << 20):
    """(first place, hashes by row, place and letter) of replacements in words of one length, about ``size`` hashes at a time."""
    n, length = codes.shape
    power = _powers(length)[:length]
    h = word_hash(codes)
    step = max(1, size // (n * len(alphabet)))
    for i in range(0, length, step):
        here = slice(i, i + step)
        yield i, h[:, None, None] - (codes[:, here] * power[here])[:, :, None] + alphabet * power[here, None]


def mask_of(h: np.ndarray) -> np.ndarray:
    """The bits that a mixed hash sets in its block."""
    out = np.zeros(h.shape, np.uint64)
    for i in range(BITS):
        out |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return out


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def codes_of(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)


def by_length(batches, letters: int = 1 << 18):
    """(length, words) of Arrow batches, at most about ``letters`` letters at a time."""
    for b in batches:
        words = b.column(0).to_pylist()
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(len(w), []).append(w)
        for length, ws in groups.items():
            step = max(1, min(1024, letters // length))
            for i in range(0, len(ws), step):
                yield length, ws[i : i + step]


def shards(words: DataFrame) -> list[list[tuple[int, int, int, int]]]:
    """Rounds of shards (length, part, parts, blocks) whose blocks stay within BLOCKS a round; a length of too many words has several parts."""
    rounds, room = [], 0
    for length, n in sorted(words.groupBy(F.length("word").alias("l")).count().collect()):
        blocks = max(1, -(-n // LOAD))
        parts = -(-blocks // BLOCKS)
        for part in range(parts):
            size = -(-blocks // parts)
            if size > room:
                rounds.append([])
                room = BLOCKS
            rounds[-1].append((length, part, parts, size))
            room -= size
    return rounds


def build_filters(words: DataFrame, turn: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, np.ndarray]]:
    """length -> (part, parts, blocks) of the shards of one round, from bits combined in Spark."""
    plan = {length: (part, parts, blocks) for length, part, parts, blocks in turn}

    def run(batches):
        for length, ws in by_length(batches):
            if length in plan:
                part, parts, blocks = plan[length]
                h = mix(word_hash(codes_of(ws, length)))
                h = h[h % np.uint64(parts) == part]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), length, np.int32)), pa.array(block_of(h, blocks)), pa.array(mask_of(h).view(np.int64))], names=["length", "block", "mask"])

    got = words.select("word").mapInArrow(run, "length int, block long, mask long").groupBy("length", "block").agg(F.bit_or("mask").alias("mask")).toArrow()
    length, block, mask = (got.column(i).to_numpy() for i in range(3))
    out = {}
    for k, (part, parts, blocks) in plan.items():
        filled = np.zeros(blocks, np.uint64)
        filled[block[length == k]] = mask[length == k].view(np.uint64)
        out[k] = (part, parts, filled)
    return out


def known(h: np.ndarray, shard: tuple[int, int, np.ndarray]) -> np.ndarray:
    """Whether the filter of a length may hold the words of these (unmixed) hashes; false for those of another part."""
    part, parts, filled = shard
    h = mix(h)
    m = mask_of(h)
    return (filled[block_of(h, len(filled))] & m == m) & (h % np.uint64(parts) == part)


def positives(words: DataFrame, alphabet: np.ndarray, filters) -> DataFrame:
    """(edit, word): the edits that the filters (a broadcast) know."""

    def run(batches):
        held = filters.value
        for length, ws in by_length(batches):
            codes = codes_of(ws, length)
            edits, source = [], []
            if length - 1 in held:
                ok = known(deletion_hashes(codes), held[length - 1])
                ok[:, 1:] &= codes[:, 1:] != codes[:, :-1]  # of equal neighbours one is left out
                for r, i in zip(*np.nonzero(ok), strict=True):
                    edits.append(ws[r][:i] + ws[r][i + 1 :])
                    source.append(ws[r])
            for first, hashes in replacement_hashes(codes, alphabet) if length in held else ():
                ok = (alphabet > codes[:, first : first + hashes.shape[1], None]) & known(hashes, held[length])
                for r, i, a in zip(*np.nonzero(ok), strict=True):
                    i += first
                    edits.append(ws[r][:i] + chr(int(alphabet[a])) + ws[r][i + 1 :])
                    source.append(ws[r])
            yield pa.RecordBatch.from_arrays([pa.array(edits, pa.string()), pa.array(source, pa.string())], names=["edit", "word"])

    return words.select("word").mapInArrow(run, "edit string, word string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): each pair of words at one edit, once."""
    spark = words.sparkSession
    letters = sorted(r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect() if r[0])
    alphabet = np.array([ord(c) for c in letters], np.uint64)
    found = None
    for turn in shards(words):
        filters = spark.sparkContext.broadcast(build_filters(words, turn))
        got = materialise(positives(words, alphabet, filters), "positives")
        filters.destroy()
        found = got if found is None else found.unionByName(got)
    if found is None:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b"))
    return found.join(words.select(F.col("word").alias("edit")), "edit").select(F.col("word").alias("a"), F.col("edit").alias("b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), which have no circles, by doubling pointers; only words that have a form."""
    up = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        nxt = up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        nxt = materialise(nxt, "roots")
        up = nxt.select("word", "root")
        if nxt.filter("moved").isEmpty():
            return up


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of a vocabulary (word, n)."""
    words = materialise(words.select("word", "n").repartition(F.col("word")), "vocabulary")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("neg"), "b")).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("b"), (-F.col("best.neg")).alias("m"))
    ok = F.col("m") >= F.lit(times) * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("b")).alias("form"), F.when(ok, F.col("m")).alias("form_n"))
    out = materialise(out, "variants")
    top = roots(out.filter("form is not null"))
    return out.join(top, "word", "left").withColumn("root", F.coalesce("root", "word"))
