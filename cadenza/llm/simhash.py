"""Op 5: SimHash near-duplicates by a binary-trie self-join.

Fingerprints are computed in one narrow Arrow pass. Equal fingerprints become one node, so exact copies
cost nothing later. Two fingerprints with at most ``budget`` differing bits agree in at least one of
``budget + 1`` blocks of bits: nodes are dealt by (block, its value), and each deal is self-joined on a
binary trie: node pairs are walked down together, differing bits add up, and a pair over the budget is
dropped with everything below. Only a spanning forest of the links found leaves a task, and pairs of
subtrees that already belong to one tree of it are skipped, so no group is expanded into all pairs.
Deals of more than ``hot`` nodes are dealt again by blocks of the remaining bits, level by level, which
loses no link.

``keep_similar`` serves a similarity of word shingles instead of a count of bits. At 0.8 two 64-bit
fingerprints differ by ten bits, too many for blocks that must agree, so it takes four fingerprints of each
text, side by side, and deals by ``width`` of their bits, chosen at random for each of enough tables that a
pair at the similarity is missed with probability ``miss`` at most. The trie join, with a budget that such
pairs keep to, then finds links, and each is checked on the whole shingle sets. The first join gives a spanning
forest, in which a link that the check refutes may have hidden a true one. So the nodes that refuted links
connect are joined a second time, for all pairs between those that verified links have not brought together.
In that join a sketch goes with each text, the parities of its shingles in 512 buckets: sets whose parities
differ more often than sets at the similarity can differ at all are no pair, so most chance comers end in
their deal and no link is lost.

Null text is empty; a document without words has fingerprint zero and links like any other. Repeated
rows share a fingerprint; rows without id take part but give no component its id. An empty table gives
an empty table. Extra columns are ignored; ``keep_one`` and ``keep_similar`` pass them through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import small
from cadenza.llm.components import connected_components
from cadenza.runtime import materialise

BITS = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over XXH64 (seed 42) of the text's space-joined word shingles, repeats included."""
    import xxhash

    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    h = xxhash.xxh64_intdigest
    if len(ws) <= words:
        return h(b" ".join(ws), 42)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(ws) - words + 1
    counts = np.zeros(BITS, np.int64)
    s, e = starts[:n].tolist(), (ends[words - 1 :] - 1).tolist()
    for at in range(0, n, 65536):
        hs = np.array([h(joined[a:b], 42) for a, b in zip(s[at : at + 65536], e[at : at + 65536], strict=True)], "<u8")
        counts += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, rid, fp): rid hashes a row's id and text; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "rid", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, rid long, fp long")


class Forest:
    """Labels of the least connected member over numpy index arrays, and the pairs that connected them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        lab = self.label
        while True:
            x, y = lab[a], lab[b]
            differ = np.flatnonzero(x != y)
            if not len(differ):
                break
            a, b = a[differ], b[differ]
            lo, hi = np.minimum(x[differ], y[differ]), np.maximum(x[differ], y[differ])
            order = np.lexsort((lo, hi))
            first = order[np.concatenate(([True], hi[order][1:] != hi[order][:-1]))]
            lab[hi[first]] = lo[first]
            self.pairs.append((a[first], b[first]))
            while not np.array_equal(nxt := lab[lab], lab):
                lab = nxt
        self.label = lab


class Across(Forest):
    """All pairs whose members have different labels, which stay as they are, but for those that ``possible`` rules out."""

    def __init__(self, label: np.ndarray, possible: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        super().__init__(0)
        self.label, self.possible = label, possible

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = np.flatnonzero(self.label[a] != self.label[b])
        if self.possible is not None and len(differ):
            differ = differ[self.possible(a[differ], b[differ])]
        if len(differ):
            self.pairs.append((a[differ], b[differ]))


def trie_links(codes: np.ndarray, group: np.ndarray, budgets: tuple[int, ...], block: int = 200_000, labels: np.ndarray | None = None, possible: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within each group that differ in at most budgets[-1] bits; with labels, all such pairs of different labels that ``possible`` holds for.

    codes has a column for each 64 bits; rows are distinct within a group and sorted by group and columns.
    A trie node is a range of that order; a frontier holds node pairs of one depth, and at most ``block``
    of them are opened at a time. Where both nodes hold one code, their remaining bits are compared at
    once. Lesser budgets first let close pairs form the forest before distant ones.
    """
    n, lanes = codes.shape
    forest = Forest(n) if labels is None else Across(labels, possible)
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], n)
    keep = ends - cuts > 1
    cuts, ends = cuts[keep], ends[keep]
    ones: dict[int, np.ndarray] = {}

    def before(depth: int) -> np.ndarray:
        """How many of the first i codes have a set bit where depth bits remain."""
        if depth not in ones:
            bit = (codes[:, (64 * lanes - depth) // 64] >> np.uint64((depth - 1) % 64)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
        return ones[depth]

    for budget in budgets:
        stack = [(64 * lanes, cuts, ends, cuts, ends, np.zeros(len(cuts), np.int64))]
        while stack:
            depth, al, ah, bl, bh, diff = stack.pop()
            if len(al) > block:
                half = len(al) // 2
                stack += [(depth, al[half:], ah[half:], bl[half:], bh[half:], diff[half:]), (depth, al[:half], ah[:half], bl[:half], bh[:half], diff[:half])]
                continue
            lab = forest.label
            changes = np.concatenate(([0], np.cumsum(lab[1:] != lab[:-1])))
            todo = (changes[ah - 1] != changes[al]) | (changes[bh - 1] != changes[bl]) | (lab[al] != lab[bl])
            al, ah, bl, bh, diff = (x[todo] for x in (al, ah, bl, bh, diff))
            leaf = (ah - al == 1) & (bh - bl == 1)
            if leaf.any():
                x, y = al[leaf], bl[leaf]
                near = np.bitwise_count(codes[x] ^ codes[y]).sum(axis=1, dtype=np.int64) <= budget
                forest.link(x[near], y[near])
                al, ah, bl, bh, diff = (x[~leaf] for x in (al, ah, bl, bh, diff))
            # what remains below can't exceed the budget: every pair links, so one member stands for all
            sure = (diff + depth <= budget) & (labels is None)
            if sure.any():
                for x, l, h in ((al, al, ah), (bl, bl, bh)):
                    size = (h - l)[sure]
                    first = np.repeat(x[sure], size)
                    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(l[sure], size)
                    forest.link(first, inner)
                forest.link(al[sure], bl[sure])
                al, ah, bl, bh, diff = (x[~sure] for x in (al, ah, bl, bh, diff))
            if depth == 0 or not len(al):
                continue
            set_before = before(depth)
            am, bm = ah - (set_before[ah] - set_before[al]), bh - (set_before[bh] - set_before[bl])
            own = (al == bl) & (ah == bh)
            out = []
            for (xl, xh), (yl, yh), d, ok in (((al, am), (bl, bm), 0, True), ((am, ah), (bm, bh), 0, True), ((al, am), (bm, bh), 1, True), ((am, ah), (bl, bm), 1, ~own)):
                take = (xh > xl) & (yh > yl) & (diff + d <= budget) & ok & ~((xl == yl) & (xh - xl == 1) & (yh - yl == 1))
                out.append((xl[take], xh[take], yl[take], yh[take], diff[take] + d))
            stack.append((depth - 1, *(np.concatenate(x) for x in zip(*out, strict=True))))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*forest.pairs, strict=True)) if forest.pairs else (none, none)


def _joined(dealt: DataFrame, lanes: int, budgets: tuple[int, ...], similarity: float = 0.0) -> DataFrame:
    """(u, v): the forest of each deal of dealt (key, node, c0, c1 ...), or with a column label all pairs across labels that may reach the similarity. A deal is held by one task, with few others at a time."""
    cols = [f"c{i}" for i in range(lanes)]
    labelled = ["label", *SKETCH] if "label" in dealt.columns else []

    def solve(t: pa.Table):
        node, key = t.column("node").to_numpy(), t.column("key").to_numpy()
        codes = np.stack([t.column(c).to_numpy().view(np.uint64) for c in cols], axis=1)
        order = np.lexsort((*codes.T[::-1], key))
        labels = possible = None
        if labelled:
            labels, n, *parity = (t.column(c).to_numpy()[order] for c in labelled)
            possible = may_reach(n, np.stack(parity, axis=1), similarity)
        a, b = trie_links(codes[order], key[order], budgets, labels=labels, possible=possible)
        f = node[order]
        return pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], names=["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < 100_000 // lanes:
                continue
            key = held.column("key").to_numpy()
            last = int(np.argmax(key == key[-1]))  # the last deal may go on in the next batch
            if last:
                yield solve(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield solve(held)

    return dealt.select("key", "node", *cols, *labelled).repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _large(dealt: DataFrame, hot: int) -> DataFrame | None:
    """The keys of more than hot rows, broadcast if they are few; None if there are none."""
    large = materialise(dealt.groupBy("key").count().filter(F.col("count") > hot).select("key"), "large-deals")
    return None if large.isEmpty() else small(large, F.lit(8))


def links(nodes: DataFrame, budget: int = 3, hot: int = 50_000) -> DataFrame:
    """(u, v): a spanning forest, task by task, of the distinct fingerprints (fp) within budget bits."""
    k, width, found = budget + 1, BITS, None
    rows = nodes.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    while True:
        # the key's bits leave rest, so that a deal can be dealt again by what remains
        size = width // k
        cut = lambda low: F.shiftleft(F.shiftrightunsigned("rest", low + size), low).bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1)))  # noqa: E731, B023
        one = lambda i: F.struct(F.xxhash64("key", F.lit(i), F.shiftrightunsigned("rest", i * size).bitwiseAND(F.lit((1 << size) - 1))).alias("key"), cut(i * size).alias("rest"))  # noqa: E731, B023
        dealt = rows.select("fp", F.explode(F.array(*map(one, range(k)))).alias("x")).select("fp", "x.key", "x.rest")
        width -= size
        large = _large(dealt, hot) if width // k > 1 else None
        here = dealt if large is None else dealt.join(large, "key", "left_anti")
        got = _joined(here.select("key", F.col("fp").alias("node"), F.col("fp").alias("c0")), 1, (budget,))
        found = got if found is None else found.union(got)
        if large is None:
            return found
        rows = dealt.join(large, "key", "left_semi")


def rooted_rows(docs: DataFrame, id_col: str, text_col: str, words: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows (doc_id, rid, fp), and (fp, root) of all their fingerprints."""
    rows = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = rows.select("fp").distinct()
    roots = connected_components(links(nodes, budget)).withColumnRenamed("node", "fp")
    return rows, materialise(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links lead to, its own included."""
    rows, rooted = rooted_rows(docs, id_col, text_col, words, budget)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    least = first.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """One row of docs of each component: that of the smallest doc_id (null ids last), then of the smallest hash of id and text."""
    return one_of_each(docs, *rooted_rows(docs, id_col, text_col, words, budget), id_col, text_col)


def one_of_each(docs: DataFrame, rows: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of docs that keep_one keeps, for each root of rooted (fp, root). A row is known by its id and the hash of id and text."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")
    first = rows.groupBy("fp").agg(F.min(order).alias("first"))
    least = first.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("least"))
    stays = least.select(F.col("least.rid").alias("__stays"), F.col("least.doc_id").alias("__stays_id"))
    kept = docs.join(stays, (F.xxhash64(docs[id_col], docs[text_col]) == F.col("__stays")) & docs[id_col].cast("long").eqNullSafe(F.col("__stays_id")), "left_semi")
    twice = rows.groupBy("doc_id", "rid").count().filter("count > 1")
    return kept if twice.isEmpty() else kept.withColumn("__rid", F.xxhash64(id_col, text_col)).dropDuplicates([id_col, "__rid"]).drop("__rid")


#: Fixed numbers that make further fingerprints of the same shingle hashes, one for each 64 bits.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


#: The size of a set of shingles and 512 parities of it, each of the shingles in one bucket of their hashes.
SKETCH = ("n", *(f"p{i}" for i in range(8)))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct XXH64 hashes (seed 42) of the text's shingles, as signed longs; fewer words are one shingle."""
    import xxhash

    ws = (text or "").encode().lower().split()
    if not ws:
        return np.zeros(0, np.int64)
    h = xxhash.xxh64_intdigest
    joined = b" ".join(ws)
    if len(ws) <= words:
        return np.array([h(joined, 42)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(ws) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64).view(np.int64))


def wide_code(sh: np.ndarray) -> np.ndarray:
    """len(LANES) fingerprints of a set of shingle hashes; zero for none."""
    out = np.zeros(len(LANES), np.int64)
    x = sh.view(np.uint64)
    for i, odd in enumerate(LANES):
        count = np.zeros(64, np.int64)
        for at in range(0, len(x), 65536):
            h = x[at : at + 65536] * np.uint64(odd)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(odd)
            h ^= h >> np.uint64(29)
            count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if len(x):
            out[i] = np.packbits(2 * count > len(x), bitorder="little").view("<i8")[0]
    return out


def sketch(sh: np.ndarray) -> np.ndarray:
    """The SKETCH of a set of shingle hashes."""
    odd = np.bincount((sh.view(np.uint64) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.concatenate(([len(sh)], np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")))


def may_reach(n: np.ndarray, parity: np.ndarray, similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test of pairs of rows that no pair at the similarity (Jaccard) fails: two sets differ by at least as many members as parities."""
    share, parity = (1 - similarity) / (1 + similarity), parity.view(np.uint64)
    return lambda a, b: np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64) <= share * (n[a] + n[b]) + 1e-6


def wide_rows(texts: DataFrame, words: int, bits: int = 64) -> DataFrame:
    """(doc_id, rid, fp, fp2, c0, c1 ..., SKETCH) of texts (doc_id, rid, text): fp and fp2 hash the set of shingles; bits of fp are used."""
    cols = [*(f"c{i}" for i in range(len(LANES))), *SKETCH]

    def run(batches):
        import xxhash

        for b in batches:
            fp, fp2, codes = [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), words)
                fp.append(xxhash.xxh64_intdigest(s.tobytes(), 42) >> (64 - bits))
                fp2.append(xxhash.xxh64_intdigest(s.tobytes(), 43))
                codes.append(np.concatenate((wide_code(s), sketch(s))))
            c = np.array(codes, np.int64).reshape(len(codes), len(cols))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.array(f, np.uint64).view(np.int64)) for f in (fp, fp2)), *map(pa.array, c.T.copy())], names=["doc_id", "rid", "fp", "fp2", *cols])

    return texts.select("doc_id", "rid", "text").mapInArrow(run, "doc_id long, rid long, fp long, fp2 long, " + ", ".join(f"{c} long" for c in cols))


def apart(rows: DataFrame) -> DataFrame:
    """rows without fp2, where sets that share fp but not fp2 get names of their own."""
    clash = rows.groupBy("fp").agg(F.min("fp2").alias("lo"), F.max("fp2").alias("hi")).filter("lo != hi").select("fp", F.lit(True).alias("clash"))
    clash = materialise(clash, "clashes")
    if clash.isEmpty():
        return rows.drop("fp2")
    own = F.when(F.col("clash"), F.xxhash64("fp", "fp2")).otherwise(F.col("fp"))
    return materialise(rows.join(small(clash, F.lit(9)), "fp", "left").withColumn("fp", own).drop("fp2", "clash"), "apart")


def tables_for(p: float, width: int, miss: float) -> int:
    """Tables of width bits that leave a pair whose bits differ with probability p unmet with probability miss."""
    return math.ceil(math.log(miss) / math.log(1 - (1 - p) ** width))


def _sample_bits(rows: DataFrame, width: int, tables: int, seed: int) -> DataFrame:
    """rows (key, node, c0 ..., maybe label and SKETCH) once for each table: the key takes in the table and the values of its bits."""
    cols = [f"c{i}" for i in range(len(LANES))]
    others = [*cols, *(["label", *SKETCH] if "label" in rows.columns else [])]
    picks = np.stack([np.random.default_rng([seed, t]).permutation(64 * len(LANES))[:width] for t in range(tables)])

    def run(batches):
        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            codes = np.stack([b.column(i).to_numpy() for i in range(2, 2 + len(cols))], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(len(key), -1), axis=1, bitorder="little")
            for t, pick in enumerate(picks):
                value = bits[:, pick].astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
                k = (key * np.uint64(LANES[1]) + (np.uint64(t) << np.uint64(40)) + value + np.uint64(seed)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), *(b.column(i) for i in range(1, 2 + len(others)))], names=["key", "node", *others])

    return rows.select("key", "node", *others).mapInArrow(run, "key long, node long, " + ", ".join(f"{c} long" for c in others))


def similar_links(nodes: DataFrame, similarity: float, miss: float, width: int, hot: int = 50_000) -> DataFrame:
    """(u, v): pairs of nodes (fp, c0 ...) that may reach the similarity, a spanning forest task by task; of nodes with a label, all pairs of different labels that their SKETCH does not rule out.

    Tables take ``width`` bits.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * len(LANES)
    budget = math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))
    rows, found, level = nodes.withColumn("key", F.lit(0).cast("long")).withColumnRenamed("fp", "node"), None, 0
    while True:
        # pairs in a deal that is dealt again meet in other tables too, so fewer tables do there
        dealt = _sample_bits(rows, width, tables_for(p, width, miss if level == 0 else 0.15), level)
        large = _large(dealt, hot) if level < 3 else None
        here = dealt if large is None else dealt.join(large, "key", "left_anti")
        got = _joined(here, len(LANES), (budget,) if "label" in nodes.columns else tuple(budget * i // 4 for i in (1, 2, 3, 4)), similarity)
        found = got if found is None else found.union(got)
        if large is None:
            return found
        rows, width, level = dealt.join(large, "key", "left_semi"), 8, level + 1


def similar(pairs: DataFrame, rows: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of fp, with a flag ``near``: whether their whole shingle sets overlap by at least the similarity (Jaccard)."""
    pairs = materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    asked = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    rids = rows.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("rid").alias("rid"))
    rids = small(materialise(rids, "asked"), F.lit(16))
    one = texts.select("rid", "text").join(rids, "rid").dropDuplicates(["fp"]).select("fp", "text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words) for t in b.column(1)], pa.list_(pa.int64()))], names=["fp", "s"])

    sets = materialise(one.mapInArrow(run, "fp long, s array<long>"), "shingle-sets")
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    near = shared + F.lit(1e-9) >= F.lit(similarity) * (F.size("a") + F.size("b") - shared)
    return materialise(both.select("u", "v", near.alias("near")), "checked")


def similar_pairs(nodes: DataFrame, rows: DataFrame, texts: DataFrame, words: int, similarity: float, miss: float) -> DataFrame:
    """(u, v): verified links that connect all nodes (fp, c0 ...) that links at the similarity connect, but for those missed by the tables."""
    width = max(12, nodes.count().bit_length() - 4)  # some sixteen chance comers a deal
    checked = similar(similar_links(nodes, similarity, miss, width), rows, texts, words, similarity)
    near, refuted = checked.filter("near").select("u", "v"), checked.filter("not near").select("u", "v")
    if refuted.isEmpty():
        return near
    # what a refuted link has joined may hide a true link between other members of the two sides
    groups = connected_components(checked.select("u", "v"))
    doubtful = groups.join(refuted.select(F.col("u").alias("node")), "node", "left_semi").select("root").distinct()
    of = groups.join(doubtful, "root", "left_semi").select(F.col("node").alias("fp"))
    known = connected_components(near).select(F.col("node").alias("fp"), F.col("root").alias("label"))
    again = nodes.join(of, "fp", "left_semi").join(known, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    again = materialise(again, "doubtful")
    pairs = similar_links(again, similarity, miss, width)
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(refuted, ["u", "v"], "left_anti")
    return near.union(similar(pairs, rows, texts, words, similarity).filter("near").select("u", "v"))


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, miss: float = 0.005, bits: int = 64) -> DataFrame:
    """One row of docs of each component of texts whose distinct word shingles overlap by the similarity, chosen as in keep_one."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    rows = apart(materialise(wide_rows(texts, words, bits), "wide-fingerprints"))
    nodes = materialise(rows.drop("doc_id", "rid").dropDuplicates(["fp"]), "nodes")
    found = similar_pairs(nodes, rows, texts, words, similarity, miss)
    roots = connected_components(found).withColumnRenamed("node", "fp")
    rooted = materialise(nodes.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")
    return one_of_each(docs, rows.select("doc_id", "rid", "fp"), rooted, id_col, text_col)
