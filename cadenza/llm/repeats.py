"""Op 13: removal of repeated word windows by seed and extend.

A window is ``words`` consecutive words. Its anchor is the leftmost least hash of its ``gram``-word
shingles (winnowing), which its words alone determine, so equal windows have equal anchors at equal places.

1. Seed: one narrow Arrow pass lists the anchors with a hash of their context, which is all that their
   windows can reach. Anchors meet by hash. An occurrence whose whole context stands in a document with a
   smaller id is covered at once, so copies of any number cost one row each; copies within a stretch of
   texts are told apart before the shuffle. What remains is the first document of each of an anchor's
   different contexts.
2. Extend: those contexts are fetched and compared word by word, outwards from the anchor to both sides.
   Occurrences that agree for j words before it and ``words - gram - j`` behind it share the window that
   starts j words before the anchor; the widest run of windows that a smaller id has too is the maximal
   repeat through this anchor. An anchor of more than ``CROWD`` contexts is dealt by its windows instead.
3. Repeats of at least ``words`` words return to their documents, which yields the kept words.

Anchors that are frequent in a sample of documents are dealt by context too; the sample steers only how rows
are dealt, not what is found. Words meet by XXH64, contexts by two 64-bit hashes (anchor and context).

Words are separated by the six ASCII white-space bytes. Null text has no words. Rows that share a doc_id are
not earlier than each other, each is judged by its own text; a null doc_id is neither smaller nor larger than
any, so its rows stay whole and cover nothing. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.runtime import materialise

#: Words that are hashed together, bytes of a text that are split at once, and words that a worker remembers.
STRETCH, PIECE, CACHE = 1 << 18, 1 << 20, 1 << 19
#: Contexts that a task compares at once; an anchor of more is dealt by its windows.
CHUNK = CROWD = 20_000
#: Parts to which a frequent anchor is dealt; one document in SAMPLE shows which are, by so many occurrences.
SALT, SAMPLE, FREQUENT, MOST = 64, 32, 32, 10_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers of the words at the places of a shingle or context.
ODD = np.random.default_rng(20_240_229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """XXH64 of the words of a text, never zero; the words seen last are remembered."""

    def __init__(self):
        import xxhash

        self.hash, self.known = xxhash.xxh64_intdigest, {}

    def of(self, word: bytes) -> int:
        if len(self.known) >= CACHE:
            self.known.clear()
        return self.known.setdefault(word, self.hash(word) or 1)

    def __call__(self, text: str | None) -> np.ndarray:
        get, parts = self.known.get, []
        for piece in pieces((text or "").encode()):
            ws = piece.split()
            parts.append(np.fromiter((get(w) or self.of(w) for w in ws), np.uint64, len(ws)))
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def pieces(raw: bytes):
    """raw in parts of about PIECE bytes, cut at white space."""
    at = 0
    while at < len(raw):
        cut = SPACE.search(raw, at + PIECE)
        end = cut.end() if cut else len(raw)
        yield raw[at:end]
        at = end


def anchors(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, c, at): shingle hash, context hash and place of the anchors of all windows within the given stretches of word hashes."""
    span, n = words - gram, len(a)
    if n < words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        h += a[i : i + len(h)] * ODD[i]
    h = mix(h)
    low = np.uint64((1 << 24) - 1)
    least, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while width < span + 1:
        step = min(width, span + 1 - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    edge = np.zeros(len(least) + 1, np.int32)
    whole = ends - starts >= words
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, ends[whole] - words + 1, -1)
    at = np.unique((least[np.cumsum(edge[:-1]) > 0] & low).astype(np.int64))
    piece = np.searchsorted(starts, at, side="right") - 1
    around = at[:, None] + np.arange(-span, words)
    inside = (around >= starts[piece, None]) & (around < ends[piece, None])
    c = np.where(inside, a[np.clip(around, 0, n - 1)], np.uint64(0)) * ODD[gram : gram + span + words]
    return h[at], mix(c.sum(axis=1, dtype=np.uint64)), at


def _stretches(texts: list[str | None], words: int, gram: int, hashes: WordHashes):
    """Lists of (index of the text, place of its first hash, hashes, first and last place to keep) of about STRETCH words; long texts in cuts with margins."""
    held, size = [], 0
    for i, t in enumerate(texts):
        a = hashes(t)
        for at in range(0, len(a) if len(a) >= words else 0, STRETCH):
            lo = max(0, at - words + gram)
            part = a[lo : at + STRETCH + words]
            held.append((i, lo, part, at, at + STRETCH))
            size += len(part)
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def list_anchors(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """(h, c, doc, rid, at, dup) of all anchors of docs(doc, rid, text); dup: the same context was seen with a smaller doc in the same stretch (h is then arbitrary)."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            doc, rid = b.column(0).to_numpy(), b.column(1).to_numpy()
            for held in _stretches(b.column(2).to_pylist(), words, gram, hashes):
                row, base, keep_from, keep_to = (np.array([x[k] for x in held]) for k in (0, 1, 3, 4))
                ends = np.cumsum([len(x[2]) for x in held])
                starts = np.concatenate(([0], ends[:-1]))
                h, c, at = anchors(np.concatenate([x[2] for x in held]), starts, ends, words, gram)
                piece = np.searchsorted(starts, at, side="right") - 1
                place = at - starts[piece] + base[piece]
                ok = (place >= keep_from[piece]) & (place < keep_to[piece])
                h, c, place, r = h[ok], c[ok], place[ok], row[piece[ok]]
                order = np.lexsort((place, doc[r], c, h))
                h, c, place, r = h[order], c[order], place[order], r[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                d, q = doc[r], rid[r]
                dup = d > d[lead]
                h = np.where(dup, mix(d.view(np.uint64) ^ mix(place.view(np.uint64))), h)
                cols = [h.view(np.int64), c.view(np.int64), d, q, place.astype(np.int32), dup]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "c", "doc", "rid", "at", "dup"])

    return docs.mapInArrow(run, "h long, c long, doc long, rid long, at int, dup boolean")


def frequent_anchors(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """(h) of at most MOST anchors that many of a sample of documents hold."""
    seen = list_anchors(docs.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0), words, gram).filter("not dup").groupBy("h").count()
    return seen.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MOST).select("h", F.lit(True).alias("frequent"))


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number for each different pair (x, y); x is below the number of rows."""
    y = np.unique(y, return_inverse=True)[1]
    return np.unique(x * len(y) + y, return_inverse=True)[1]


def extend(group: np.ndarray, doc: np.ndarray, ctx: np.ndarray, before: np.ndarray, after: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, least and most words before the anchor at which a window starts that a smaller doc of the group has too).

    ctx has the hashes of words - gram words before, the anchor's, and words - gram behind; before and after count the real ones.
    """
    span, n = words - gram, len(doc)
    for i in range(gram):  # anchors whose hashes lie are kept apart
        group = _pairs(group, ctx[:, span + i])
    left, right = [group], [group]
    for j in range(1, span + 1):
        left.append(_pairs(left[-1], ctx[:, span - j]))
        right.append(_pairs(right[-1], ctx[:, span + gram - 1 + j]))
    lo, hi = np.full(n, words), np.full(n, -1)
    for j in range(span + 1):
        rows = np.flatnonzero((before >= j) & (after >= span - j))
        name = _pairs(left[j][rows], right[span - j][rows]) if len(rows) else rows
        first = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(first, name, doc[rows])
        again = rows[doc[rows] > first[name]]
        lo[again] = np.minimum(lo[again], j)
        hi[again] = j
    row = np.flatnonzero(hi >= 0)
    return row, lo[row], hi[row]


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, width)


def _crowded(contexts: DataFrame, words: int, gram: int) -> DataFrame:
    """(doc, rid, s, e) of the repeated windows of anchors with very many contexts, which meet by two hashes."""
    span = words - gram

    def run(batches):
        for b in batches:
            doc, rid, at, before, after = (b.column(i).to_numpy() for i in range(1, 6))
            ctx = _matrix(b.column(6), words + span)
            for j in range(span + 1):
                ok = (before >= j) & (after >= span - j)
                w = ctx[ok, span - j : span - j + words]
                names = [mix((w * ODD[k : k + words]).sum(axis=1, dtype=np.uint64)).view(np.int64) for k in (64, 128)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*names, doc[ok], rid[ok], at[ok] - j)], names=["n1", "n2", "doc", "rid", "s"])

    x = contexts.select("h", "doc", "rid", "at", "before", "after", "ctx").mapInArrow(run, "n1 long, n2 long, doc long, rid long, s int")
    first = x.groupBy("n1", "n2").agg(F.min("doc").alias("first"))
    again = x.join(first, ["n1", "n2"]).filter(F.col("doc") > F.col("first"))
    return again.select("doc", "rid", "s", (F.col("s") + words).alias("e"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 13, gram: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words, joined by spaces, as UTF-8) of every document."""
    span = words - gram
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    alone = d.groupBy("doc").count().filter("count > 1").isEmpty()
    d = d.select("doc", (F.lit(0).cast("long") if alone else F.xxhash64("text")).alias("rid"), "text")
    own = d.filter("doc is not null")
    frequent = materialise(frequent_anchors(own, words, gram), "frequent-anchors")
    listed = list_anchors(own, words, gram).join(F.broadcast(frequent), "h", "left")
    listed = listed.withColumn("salt", F.when(F.col("frequent"), F.pmod("c", F.lit(SALT))).otherwise(0))
    listed = listed.repartition("h", "salt").sortWithinPartitions("h", "salt", "c", "doc")
    by_anchor, by_context = W.partitionBy("h", "salt"), W.partitionBy("h", "salt", "c")
    t = listed.withColumn("again", F.col("dup") | (F.col("doc") > F.min("doc").over(by_context)))
    differ = (F.min("c").over(by_anchor) < F.max("c").over(by_anchor)) & (F.min("doc").over(by_anchor) < F.max("doc").over(by_anchor))
    t = t.withColumn("many", F.coalesce("frequent", F.lit(False)) | differ).filter("again or many")
    t = materialise(t.select("doc", "rid", "at", F.when(~F.col("again"), F.col("h")).alias("h")), "repeated-anchors")

    dealt = d.repartition("doc") if alone else d  # both joins below share this exchange of the texts
    leads = t.filter("h is not null").groupBy("doc", "rid").agg(F.collect_set(F.struct("h", "at")).alias("xs"))

    def fetch(batches):
        hashes = WordHashes()
        for b in batches:
            for i in range(b.num_rows):
                a = hashes(b.column(2)[i].as_py())
                h, at = b.column(3)[i].values.field(0), b.column(3)[i].values.field(1).to_numpy()
                padded = np.concatenate((np.zeros(span, np.uint64), a, np.zeros(words, np.uint64)))
                for k in range(0, len(at), 65_536):
                    p = at[k : k + 65_536]
                    ctx = padded[p[:, None] + np.arange(span + words)]
                    cols = [np.full(len(p), b.column(0)[i].as_py()), np.full(len(p), b.column(1)[i].as_py()), p, np.minimum(p, span), np.minimum(len(a) - p - gram, span).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([h.slice(k, len(p)), *map(pa.array, cols), pa.array([x.tobytes() for x in ctx], pa.binary())], names=["h", "doc", "rid", "at", "before", "after", "ctx"])

    def solve(batches):
        def out(x: pa.Table):
            h, doc, rid, at, before, after = (x.column(i).to_numpy() for i in range(6))
            group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
            row, lo, hi = extend(group, doc, _matrix(x.column(6), span + words), before, after, words, gram)
            cols = [doc[row], rid[row], (at[row] - hi).astype(np.int32), (at[row] - lo + words).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "rid", "s", "e"])

        held = None
        for b in batches:
            x = pa.Table.from_batches([b])
            held = x if held is None else pa.concat_tables([held, x])
            if len(held) >= CHUNK:
                h = held.column("h").to_numpy()
                last = int(np.argmax(h == h[-1]))  # the last anchor may go on in the next batch
                if last:
                    yield out(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and len(held):
            yield out(held)

    contexts = dealt.join(leads, ["doc", "rid"]).select("doc", "rid", "text", "xs").mapInArrow(fetch, "h long, doc long, rid long, at int, before int, after int, ctx binary")
    crowds = materialise(t.filter("h is not null").groupBy("h").count().filter(F.col("count") > CROWD).select("h"), "crowded-anchors")
    spans = t.filter("h is null").select("doc", "rid", F.greatest(F.col("at") - span, F.lit(0)).alias("s"), (F.col("at") + words).alias("e"))
    if not crowds.isEmpty():
        contexts = materialise(contexts, "contexts")
        spans = spans.unionByName(_crowded(contexts.join(crowds, "h", "left_semi"), words, gram))
        contexts = contexts.join(crowds, "h", "left_anti")
    spans = spans.unionByName(contexts.repartition("h").sortWithinPartitions("h").mapInArrow(solve, "doc long, rid long, s int, e int"))
    per_doc = spans.groupBy("doc", "rid").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def cut(batches):
        for b in batches:
            rows = []
            for text, xs in zip(b.column(1), b.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                ws = [w for p in pieces(raw) for w in p.split()]
                n = len(ws)
                if xs.is_valid:
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, xs.values.field(0).to_numpy(), 1)
                    np.add.at(edge, np.minimum(xs.values.field(1).to_numpy(), n), -1)
                    ws = [ws[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                kept = b" ".join(ws)
                rows.append((n, n - len(ws), hashlib.sha256(kept).hexdigest(), kept))
            n, gone, digest, kept = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    whole = dealt.join(per_doc, ["doc", "rid"], "left").select("doc", "text", "spans")
    return whole.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
