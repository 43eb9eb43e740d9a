"""Op 3: removal of repeated 100-byte strings by hash-compared suffix sorting.

Every ``length``-byte string holds one anchor that its bytes alone determine: the leftmost least hash of
its ``gram``-byte substrings. Equal strings so have equal anchors at equal places, and only anchors that
occur twice need a closer look. An anchor's context is all that its strings can reach.

1. One narrow Arrow pass hashes all texts by prefix polynomial hashes and lists the anchors.
2. Anchors meet by hash, those of very many contexts by context as well. Of those with the same whole
   context all but the first are covered at once, so copies of any number cost one row each: within a
   stretch of texts after comparison of the bytes, across stretches by the two 64-bit hashes of gram and
   context. What remains are first contexts that share only the anchor.
3. Their contexts are fetched and sorted as suffixes from the anchor on, and as reversed prefixes before
   it, by a mergesort whose comparisons find the common extension by binary search over prefix hashes;
   neighbours' extensions are then verified on bytes, so a collision cannot join two strings. The string
   that starts j bytes before the anchor is named by its place in both orders: (prefixes that agree for
   j bytes, suffixes that agree for length - j); all but the first of a name are covered. An anchor of
   more than ``CROWD`` contexts is dealt by its strings instead, which meet by two 64-bit hashes.
4. Covered runs return to their documents, which yields the kept bytes.

Null text is empty. Different texts of one doc_id come one after the other in the order of their hashes;
wholly equal rows count as one document and get equal results. Null doc_ids come first. Extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.runtime import materialise

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are hashed together; longer documents are cut into stretches that overlap enough.
STRETCH = 1 << 21
#: Contexts that a task sorts at once, and those of one anchor beyond which it is dealt anew.
CHUNK, CROWD = 20_000, 50_000
#: Parts to which the contexts of a heavy anchor are dealt.
SALT = 64


class Powers:
    """Powers of a number modulo 2 ** 64, as many as were asked for so far."""

    def __init__(self, base: np.uint64):
        self.base, self.p = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.p) < n:
            self.p = np.concatenate((self.p, self.p * (self.p[-1:] * self.base)))
        return self.p[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(s: np.ndarray) -> np.ndarray:
    """P[i] = sum of s[t] * BASE ** t for t < i."""
    out = np.zeros(len(s) + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * UP.upto(len(s)), out=out[1:])
    return out


def substring_hash(p: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The hash of bytes at..to, the same wherever they stand."""
    return (p[to] - p[at]) * DOWN.upto(len(p))[at]


def anchors(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, c, at): gram hash, context hash and place of the anchors of all length-byte strings within the given stretches."""
    n = len(buffer)
    span = length - gram
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = prefix_hashes(buffer)
    h = mix((p[gram:] - p[:-gram]) * DOWN.upto(n)[: n - gram + 1])
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    least, width = key, 1
    while 2 * width <= span + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span + 1:
        rest = span + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
    whole = np.zeros(len(least), bool)
    last = ends - length
    ok = last >= starts
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, starts[ok], 1)
    np.add.at(edge, last[ok] + 1, -1)
    whole = np.cumsum(edge[:-1]) > 0
    at = (least[whole] & np.uint64((1 << 24) - 1)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    piece = np.searchsorted(starts, at, side="right") - 1
    lo, hi = np.maximum(at - span, starts[piece]), np.minimum(at + length, ends[piece])
    c = mix(substring_hash(p, lo, hi) ^ mix(((at - lo) << 16 | (hi - at)).astype(np.uint64)))
    return h[at], c, at


def _stretches(texts: list[bytes], length: int):
    """(buffer, index of the text, place in the text, starts, ends) of groups of texts of about STRETCH bytes; long texts in overlapping cuts."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), STRETCH):
            cut = t[max(0, at - length) : at + STRETCH + 2 * length]
            held.append((i, max(0, at - length), cut))
            size += len(cut)
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _same_bytes(buffer, at, to, starts, ends, lead_starts, lead_ends, rows, length: int, gram: int) -> np.ndarray:
    """Whether the contexts of the given rows are, byte by byte, those of their leads (anchors at ``to``)."""
    span, out = length - gram, np.zeros(len(rows), bool)
    col, last = np.arange(-span, length), len(buffer) - 1
    for i in range(0, len(rows), 8192):
        r = rows[i : i + 8192]
        x, y = at[r, None] + col, to[r, None] + col
        in_x, in_y = (x >= starts[r, None]) & (x < ends[r, None]), (y >= lead_starts[r, None]) & (y < lead_ends[r, None])
        same = (in_x == in_y) & (~in_x | (buffer[np.clip(x, 0, last)] == buffer[np.clip(y, 0, last)]))
        out[i : i + 8192] = same.all(axis=1)
    return out


def heavy_anchors(docs: DataFrame, length: int, gram: int, least: int = 32, most: int = 10_000) -> DataFrame:
    """(h): the anchors with the most contexts, counted where one stretch of texts has ``least`` different ones; ``most`` bounds the table."""

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(0).to_pylist()]
            for held in _stretches(texts, length):
                ends = np.cumsum([len(x[2]) for x in held])
                h, c, _ = anchors(np.frombuffer(b"".join(x[2] for x in held), np.uint8), np.concatenate(([0], ends[:-1])), ends, length, gram)
                order = np.lexsort((c, h))
                h, c = h[order], c[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                hs, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hs[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["h", "n"])

    found = docs.select("text").mapInArrow(run, "h long, n long")
    return found.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).select("h")


def list_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, doc, pk, dup) of all anchors; pk is rank << 40 | place. dup: an earlier equal context was seen in the same batch (h is then arbitrary)."""

    def run(batches):
        for b in batches:
            doc, rank = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            texts = [(t or "").encode() for t in b.column(2).to_pylist()]
            for held in _stretches(texts, length):
                row = np.array([x[0] for x in held])
                base = np.array([x[1] for x in held])
                ends = np.cumsum([len(x[2]) for x in held])
                starts = np.concatenate(([0], ends[:-1]))
                buffer = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
                h, c, at = anchors(buffer, starts, ends, length, gram)
                piece = np.searchsorted(starts, at, side="right") - 1
                place = at - starts[piece] + base[piece]
                # an anchor within reach of a cut's inner edge is listed whole by the neighbouring cut
                n = np.array([len(t) for t in texts])[row]
                lo, hi = place - base[piece] >= length, starts[piece] + length <= ends[piece] - (at - starts[piece])
                ok = ((base[piece] == 0) | lo) & ((base[piece] + (ends - starts)[piece] == n[piece]) | hi)
                h, c, piece, place = h[ok], c[ok], piece[ok], place[ok]
                d, pk = doc[row[piece]], rank[row[piece]] << 40 | place
                order = np.lexsort((pk, d, c, h))
                h, c, d, pk = h[order], c[order], d[order], pk[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                dup = ~new & ((d != d[lead]) | (pk != pk[lead]))
                at, piece = at[ok][order], piece[order]
                dup[dup] = _same_bytes(buffer, at, at[lead], starts[piece], ends[piece], starts[piece[lead]], ends[piece[lead]], np.flatnonzero(dup), length, gram)
                h = np.where(dup, mix(d.view(np.uint64) ^ mix(pk.view(np.uint64))), h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d), pa.array(pk), pa.array(dup)], names=["h", "c", "doc", "pk", "dup"])

    return docs.select("doc", "rank", "text").mapInArrow(run, "h long, c long, doc long, pk long, dup boolean")


class Strings:
    """Strings at[i]..to[i] of one buffer, with hashed comparisons."""

    def __init__(self, buffer: np.ndarray, at: np.ndarray, to: np.ndarray):
        self.s, self.at, self.n = buffer, at, to - at
        self.p = prefix_hashes(buffer)
        self.down = DOWN.upto(len(self.p))[at]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common beginning of strings x and y, by binary search over hashes."""
        ax, ay = self.at[x], self.at[y]
        px, py, dx, dy = self.p[ax], self.p[ay], self.down[x], self.down[y]
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.n[x], self.n[y])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (self.p[ax + mid] - px) * dx == (self.p[ay + mid] - py) * dy
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        e = self.extension(x, y)
        ended = (e == self.n[x]) | (e == self.n[y])
        last = len(self.s) - 1
        a, b = self.s[np.minimum(self.at[x] + e, last)].astype(np.int64), self.s[np.minimum(self.at[y] + e, last)].astype(np.int64)
        return np.where(ended, self.n[x] - self.n[y], a - b)

    def merge_sorted(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The order within groups of neighbouring rows (first row and size of each row's group), by bottom-up merging."""
        n = len(self.at)
        order, slot = np.arange(n), np.arange(n)
        off, run, most = slot - first, 1, int(size.max(initial=0))
        while run < most:
            block = off // run
            other = first + (block ^ 1) * run
            act = other < first + size
            x, lo, hi = order[act], other[act], np.minimum(other + run, first + size)[act]
            strict = (block[act] & 1) == 0
            begin = lo
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = np.flatnonzero(open_)
                c = self.compare(order[mid[at]], x[at])
                before = np.where(strict[at], c < 0, c <= 0)
                lo, hi = lo.copy(), hi.copy()
                lo[at[before]] = mid[at[before]] + 1
                hi[at[~before]] = mid[at[~before]]
            to = first[act] + (block[act] & ~1) * run + off[act] - block[act] * run + lo - begin
            order = order.copy()
            order[to] = x
            run *= 2
        return order

    def verified(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, extension to the row before in it, -1 at a group's first); rows are sorted on bytes if a hash has lied."""
        for attempt in range(2):
            x, y = order[:-1], order[1:]
            e = np.full(len(order), -1, np.int64)
            same = group[x] == group[y]
            most = int(self.n.max(initial=0))
            col = np.arange(most)
            last = len(self.s) - 1
            e[1:][same] = self.extension(x[same], y[same])
            sure = True
            for at in range(0, len(x), 4096):
                p, q = x[at : at + 4096], y[at : at + 4096]
                a, b = self.s[np.minimum(self.at[p, None] + col, last)], self.s[np.minimum(self.at[q, None] + col, last)]
                inside = col < np.minimum(self.n[p], self.n[q])[:, None]
                true = np.where(inside & (a == b), 1, 0).cumprod(axis=1).sum(axis=1)
                here = same[at : at + 4096]
                sure &= bool((true[here] == e[1:][at : at + 4096][here]).all())
                e[1:][at : at + 4096][here] = true[here]
            if sure or attempt:
                return order, e
            raw = self.s.tobytes()
            order = np.array(sorted(range(len(order)), key=lambda i: (group[i], raw[self.at[i] : self.at[i] + self.n[i]])))
        raise AssertionError


def covered(h: np.ndarray, doc: np.ndarray, pk: np.ndarray, before: np.ndarray, contexts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): for rows (sorted by h) with repeated strings, the range of j (bytes before the anchor) from the least to the largest."""
    n = len(h)
    new = np.concatenate(([True], h[1:] != h[:-1]))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)[group]
    size = np.bincount(group)[group]
    ends = np.cumsum([len(c) for c in contexts])
    starts = ends - np.array([len(c) for c in contexts])
    buffer = np.frombuffer(b"".join(contexts), np.uint8)
    names = []
    for s, at, to in ((buffer, starts + before, ends), (buffer[::-1].copy(), len(buffer) - starts - before, len(buffer) - starts)):
        strings = Strings(s, at, to)
        order, e = strings.verified(strings.merge_sorted(first, size), group)
        names.append((order, e))
    after = ends - starts - before
    chron = np.lexsort((pk, doc))
    lo, hi = np.full(n, length), np.full(n, -1)
    for j in range(length - gram + 1):
        rank = []
        for (order, e), depth in zip(names, (length - j, j), strict=True):
            r = np.empty(n, np.int64)
            r[order] = np.cumsum(e < depth)
            rank.append(r)
        name = rank[0] * (n + 1) + rank[1]
        rows = chron[((before >= j) & (after >= length - j))[chron]]
        o = np.argsort(name[rows], kind="stable")
        k = name[rows][o]
        again = rows[o[1:][k[1:] == k[:-1]]]
        lo[again] = np.minimum(lo[again], j)
        hi[again] = np.maximum(hi[again], j)
    row = np.flatnonzero(hi >= 0)
    return row, lo[row], hi[row]


def _crowded(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Covered runs of anchors with very many contexts: each string meets its equals by two hashes, combined before the shuffle."""
    j = F.explode(F.sequence(F.lit(0), F.lit(length - gram))).alias("j")
    x = contexts.select("doc", "pk", "before", "ctx", j).filter((F.col("before") >= F.col("j")) & (F.octet_length("ctx") - F.col("before") >= length - F.col("j")))
    s = F.substring("ctx", F.col("before") - F.col("j") + 1, F.lit(length))
    x = x.select("doc", (F.col("pk") - F.col("j")).alias("start"), F.xxhash64(s).alias("n1"), F.xxhash64(F.lit(1), s).alias("n2"))
    first = x.groupBy("n1", "n2").agg(F.min(F.struct("doc", "start")).alias("first"))
    again = x.join(first, ["n1", "n2"]).filter(F.struct("doc", "start") > F.col("first"))
    at = F.col("start").bitwiseAND(F.lit((1 << 40) - 1)).cast("int")
    return again.select("doc", F.shiftright("start", 40).cast("int").alias("rank"), at.alias("s"), (at + length).alias("e"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 28) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document."""
    span = length - gram
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = d.select("doc").groupBy("doc").count().filter("count > 1")
    if ids.isEmpty():
        d = d.withColumn("rank", F.lit(0))
    else:
        w = W.partitionBy("doc").orderBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
        d = d.withColumn("rank", F.dense_rank().over(w) - 1)
    # an anchor of very many contexts is dealt by them too, and taken to have many
    heavy = materialise(heavy_anchors(d, length, gram), "heavy-anchors").withColumn("heavy", F.lit(True))
    listed = list_anchors(d, length, gram).join(F.broadcast(heavy), "h", "left")
    listed = listed.withColumn("salt", F.when(F.col("heavy"), F.pmod("c", F.lit(SALT))).otherwise(0)).repartition("h", "salt").sortWithinPartitions("h", "salt", "c", "doc", "pk")
    wh = W.partitionBy("h", "salt")
    t = listed.withColumn("r", F.rank().over(W.partitionBy("h", "salt", "c").orderBy("doc", "pk"))).withColumn("many", F.coalesce("heavy", F.lit(False)) | (F.min("c").over(wh) != F.max("c").over(wh)))
    again = F.col("dup") | (F.col("r") > 1)
    at = F.col("pk").bitwiseAND(F.lit((1 << 40) - 1))
    t = t.filter(again | F.col("many")).select("doc", F.shiftright("pk", 40).cast("int").alias("rank"), at.cast("int").alias("at"), F.when(again, F.lit(None)).otherwise(F.col("h")).alias("h"))
    t = materialise(t, "repeated-anchors")

    dealt = d.repartition("doc")  # both joins below share this exchange of the texts
    reps = t.filter("h is not null").distinct().groupBy("doc", "rank").agg(F.collect_list(F.struct("h", "at")).alias("xs"))

    def fetch(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = b.column(2)[i].as_py().encode()
                doc, rank = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                xs = b.column(3)[i].values
                at = xs.field(1).to_numpy()
                ctx = [s[max(0, a - span) : a + length] for a in at.tolist()]
                n = len(at)
                yield pa.RecordBatch.from_arrays([xs.field(0), pa.array(np.full(n, doc)), pa.array(rank << 40 | at.astype(np.int64)), pa.array(np.minimum(at, span), pa.int32()), pa.array(ctx, pa.binary())], names=["h", "doc", "pk", "before", "ctx"])

    def solve(batches):
        def out(x: pa.Table):
            h, doc, pk = (x.column(c).to_numpy() for c in ("h", "doc", "pk"))
            order = np.lexsort((pk, doc, h))
            h, doc, pk = h[order], doc[order], pk[order]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pk[1:] != pk[:-1])))  # repeated rows
            x, h, doc, pk = x.take(order[once]), h[once], doc[once], pk[once]
            row, lo, hi = covered(h, doc, pk, x.column("before").to_numpy().astype(np.int64), x.column("ctx").to_pylist(), length, gram)
            at = pk[row] & ((1 << 40) - 1)
            cols = [doc[row], (pk[row] >> 40).astype(np.int32), (at - hi).astype(np.int32), (at - lo + length).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "rank", "s", "e"])

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

    runs = "doc long, rank int, s int, e int"
    contexts = dealt.select("doc", "rank", "text").join(reps, ["doc", "rank"]).select("doc", "rank", "text", "xs").mapInArrow(fetch, "h long, doc long, pk long, before int, ctx binary")
    crowds = materialise(t.filter("h is not null").groupBy("h").count().filter(F.col("count") > CROWD).select("h"), "crowded-anchors")
    spans = t.filter("h is null").select("doc", "rank", F.greatest(F.col("at") - span, F.lit(0)).alias("s"), (F.col("at") + length).alias("e"))
    if not crowds.isEmpty():
        contexts = materialise(contexts, "contexts")
        spans = spans.unionByName(_crowded(contexts.join(crowds, "h", "left_semi"), length, gram))
        contexts = contexts.join(crowds, "h", "left_anti")
    spans = spans.unionByName(contexts.repartition("h").sortWithinPartitions("h").mapInArrow(solve, runs))
    per_doc = spans.groupBy("doc", "rank").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def cut(batches):
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                s = b.column(1)[i].as_py().encode()
                n, xs = len(s), b.column(2)[i]
                if not xs.is_valid:
                    rows.append((n, 0, 0, s))
                    continue
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, xs.values.field(0).to_numpy(), 1)
                np.add.at(edge, np.minimum(xs.values.field(1).to_numpy(), n), -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
                rows.append((n, int(gone.sum()), starts, np.frombuffer(s, np.uint8)[~gone].tobytes()))
            n, gone, starts, kept = zip(*rows, strict=True) if rows else ((),) * 4
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(starts, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = dealt.select("doc_id", "doc", "rank", "text").join(per_doc, ["doc", "rank"], "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
