"""Longest common substrings of transcripts and the references of their language."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of references that are sent to the workers at once; longer ones come in parts, which overlap by the longest transcript.
REFERENCE_CHARS = 500_000


class Automaton:
    """The suffix automaton of a reference: finds any text's longest common substring in one pass over that text."""

    def __init__(self, reference: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(reference):
            new = self._state(self.length[last] + 1, at, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 < self.length[q]:
                    whole, q = q, self._state(self.length[p] + 1, self.first_end[q], dict(self.next[q]))
                    self.link[q] = self.link[whole]
                    self.link[whole] = q
                    while p >= 0 and self.next[p].get(c) == whole:
                        self.next[p][c] = q
                        p = self.link[p]
                self.link[new] = q
            last = new

    def _state(self, length: int, first_end: int, following: dict[str, int]) -> int:
        self.length.append(length)
        self.first_end.append(first_end)
        self.next.append(following)
        self.link.append(0)
        return len(self.length) - 1

    def longest(self, text: str) -> tuple[int, int, int]:
        """(place in text, place in the reference, size): the longest common substring, the earliest in text, then in the reference."""
        state = size = 0
        best = (0, 0, 0)
        for at, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
                if size > best[2]:
                    best = (at - size + 1, self.first_end[state] - size + 1, size)
        return best


_AUTOMATA: dict[str, Automaton] = {}


def automaton_of(reference: str) -> Automaton:
    """Built once for a Python worker; the references' bound is also that of the cache."""
    if reference not in _AUTOMATA:
        if sum(map(len, _AUTOMATA)) + len(reference) > REFERENCE_CHARS:
            _AUTOMATA.clear()
        _AUTOMATA[reference] = Automaton(reference)
    return _AUTOMATA[reference]


def parts_of(lengths: list[tuple[int, int]], overlap: int, most: int) -> list[list[tuple[int, int, int]]]:
    """Rounds of parts (rid, first place, end) of references (rid, length), of at most ``most`` characters a round, or a part of one overlap more.

    Every stretch of at most ``overlap`` characters lies within a part.
    """
    rounds: list[list[tuple[int, int, int]]] = [[]]
    room = most
    for rid, n in lengths:
        at = 0
        while at < max(n, 1):
            end = min(n, at + max(most - overlap, 1) + overlap)
            if end - at > room and rounds[-1]:
                rounds.append([])
                room = most
            rounds[-1].append((rid, at, end))
            room -= end - at
            if end >= n:
                break
            at = end - overlap
    return rounds


def _with_parts(transcripts: DataFrame, references: DataFrame, on: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(tid, rid, i, j, size, matched, chars) of transcripts and the parts of one round; places are those in the whole reference."""
    spark = transcripts.sparkSession
    table = spark.createDataFrame(parts, "rid long, lo long, hi long")
    cut = references.select(F.col("rid").cast("long"), F.col(on).alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(table), "rid")
    by: dict[str, list[tuple[int, int, str]]] = {}
    for r in cut.select("key", "rid", "lo", F.substring(F.col("text"), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("part")).collect():  # one round's characters
        by.setdefault(r[0], []).append((r[1], r[2], r[3]))
    shared = spark.sparkContext.broadcast(by)

    def run(batches):
        for b in batches:
            rows = []
            for tid, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                t = (text or "").strip()
                for rid, lo, part in shared.value.get(key, []):
                    i, j, n = automaton_of(part).longest(t)
                    rows.append((tid, rid, i, lo + j, n, t[i : i + n], len(t)))
            cols = zip(*rows, strict=True) if rows else ((),) * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["tid", "rid", "i", "j", "size", "matched", "chars"])

    texts = transcripts.select(F.col("tid").cast("long"), F.col(on), "text")
    return texts.mapInArrow(run, "tid long, rid long, i int, j int, size int, matched string, chars int")


def longest_common(transcripts: DataFrame, references: DataFrame, on: str) -> DataFrame:
    """Per (tid, rid) of equal ``on``: place i in the trimmed transcript, place j in the reference, size, matched, coverage.

    transcripts(tid, text, on), references(rid, text, on); tid and rid are unique. Without a common character, or with a
    blank or null transcript, coverage is 0 and the rest null. Transcripts of an ``on`` without reference have no row.
    References of any length are aligned in rounds of ``REFERENCE_CHARS`` characters, and the best of their parts counts:
    the longest, then the earliest in the transcript, then in the reference.
    """
    lengths = [(r[0], r[1]) for r in references.select(F.col("rid").cast("long"), F.coalesce(F.length("text"), F.lit(0))).orderBy("rid").collect()]  # one row a reference
    longest = transcripts.agg(F.coalesce(F.max(F.length(F.trim("text"))), F.lit(0))).first()[0]
    rounds = parts_of(lengths, longest, REFERENCE_CHARS)
    found = None
    for parts in rounds:
        got = _with_parts(transcripts, references, on, parts)
        found = got if found is None else found.unionByName(got)
    if len(rounds) > 1 or len(rounds[0]) > len(lengths):
        best = F.min(F.struct((-F.col("size")).alias("neg"), "i", "j", "matched")).alias("b")
        found = found.groupBy("tid", "rid", "chars").agg(best).select("tid", "rid", "b.i", "b.j", (-F.col("b.neg")).alias("size"), "b.matched", "chars")
    some = F.col("size") > 0
    return found.select("tid", "rid", *(F.when(some, F.col(c)).alias(c) for c in ("i", "j", "size", "matched")), F.when(some, F.col("size") / F.col("chars")).otherwise(0.0).alias("coverage"))
