"""Op 2: approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: centred principal directions of a bounded sample, turned by iteratively learned rotations, one bit
per direction by sign; as many rotations from different starts as the substrings take bits. Equal vectors
are one node. Substrings of ``width`` bits (about the logarithm of the nodes) are indexed: a node has one
row for each, keyed by (substring, value), and a query has one row for each value within ``reach`` bits of
its own. By the pigeonhole principle every code within radius m (reach + 1) - 1 of a query, for m
substrings, meets it at some key; the first one counts. Pairs that meet and whose whole codes differ by at
most ``radius`` bits are ranked by exact distance.

How many substrings to index is measured: probe vectors, the first by hash, are compared with all nodes,
and m is the least (in steps of four) for which their true neighbours meet them with the share ``recall``;
``radius`` is then the ``cover`` quantile of the code distances of those that meet. A like bound on the
first longs of the codes, which go with the keys, ends most pairs at once. Queries that find fewer than k
others are compared with all nodes, in blocks, so queries get k rows if there are as many.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without id. Of rows that repeat an id one counts (the least vector). Equal distances
go by id. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import small
from cadenza.runtime import materialise

#: Most substrings that are indexed, and longs of a code that go with every key.
MOST, HEAD = 64, 4


class Codes:
    """Rotated binary codes of at least bits bits: blocks of learned rotations of the sample's principal directions."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = 10, seed: int = 7):
        dims = sample.shape[1]
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, _, vt = np.linalg.svd(centred, full_matrices=False)
        directions = np.zeros((dims, dims))
        directions[:, : len(vt)] = vt.T
        p = centred @ directions
        blocks = []
        for block in range(-(-bits // dims)):
            r, _ = np.linalg.qr(np.random.default_rng([seed, block]).normal(size=(dims, dims)))
            for _ in range(rounds):
                u, _, wt = np.linalg.svd(np.where(p @ r >= 0, 1.0, -1.0).T @ p)
                r = (u @ wt).T
            blocks.append(directions @ r)
        self.project = np.concatenate(blocks, axis=1)[:, :bits]

    def of(self, x: np.ndarray) -> np.ndarray:
        """0/1 for every row and bit."""
        return ((x - self.mean) @ self.project >= 0).astype(np.uint8)


def masks_within(width: int, reach: int) -> list[int]:
    """All values of width bits with at most reach set."""
    return [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(width), n)]


def substrings(bits: np.ndarray, width: int) -> np.ndarray:
    """The values of the substrings of 0/1 rows."""
    return bits.reshape(len(bits), -1, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda e: e != 0), F.lit(False))


def nodes_of(rows: DataFrame, queries: Column, k: int) -> DataFrame:
    """(cid, v, ids, asked): different vectors by their least id, their k + 1 least ids, whether one of the ids is a query.

    Copies beyond k + 1 are dropped before the shuffle is read, as none of them can be among the k nearest.
    """
    w = W.partitionBy("v").orderBy("vec_id")
    asked = rows.filter(queries).select("v").distinct().withColumn("asked", F.lit(True))
    least = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    nodes = least.groupBy("v").agg(F.min("vec_id").alias("cid"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return nodes.join(asked, "v", "left").select("cid", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


def all_nearest(nodes: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(qid, cid, score): for a block of queries the k nearest nodes of every batch, by exact distance."""
    shared = nodes.sparkSession.sparkContext.broadcast((query_ids, q))

    def run(batches):
        ids, block = shared.value
        for b in batches:
            cid, x = b.column(0).to_numpy(), _matrix(b.column(1))
            out = []
            for i, v in enumerate(block):
                d = np.sqrt(((x - v) ** 2).sum(axis=1))
                best = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                best = np.flatnonzero(d <= d[best].max(initial=0))
                best = best[np.lexsort((cid[best], d[best]))][:k]
                out.append((np.full(len(best), ids[i]), cid[best], d[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["qid", "cid", "score"])

    return nodes.select("cid", "v").mapInArrow(run, "qid long, cid long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(W.partitionBy("qid").orderBy("score", "cid"))
    return found.withColumn("r", r).filter(F.col("r") <= k).drop("r")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


class Index:
    """Substring tables of the nodes' codes, with their reach and radius; see the module's text."""

    def __init__(self, nodes: DataFrame, n: int, k: int, sample_rows: int = 4096, probes: int = 64, recall: float = 0.95, cover: float = 0.99, reach: int = 3):
        first = [(r["cid"], r["v"]) for r in nodes.select("cid", "v").orderBy(F.xxhash64("cid"), "cid").limit(sample_rows).collect()]
        sample = np.array([v for _, v in first])
        self.width, self.reach = min(max(16, n.bit_length()), 24), reach
        # each substring has a slot of its own in the longs that hold a code; the first longs go with the keys
        self.slot = next(x for x in (16, 21, 32) if x >= self.width)
        self.head = HEAD * (64 // self.slot)
        self.codes = Codes(sample, MOST * self.width)
        ids = np.array([c for c, _ in first[:probes]])
        near = _best(all_nearest(nodes, ids, sample[:probes], k + 1), k + 1).filter("qid != cid").join(nodes.select("cid", "v"), "cid")
        near = [(r["qid"], r["v"]) for r in near.select("qid", "v").collect()]
        self.m, self.radius, self.head_radius = 4, 4 * self.width, 4 * self.width
        if near:
            place = {c: i for i, c in enumerate(ids.tolist())}
            a, b = self.codes.of(sample[:probes])[[place[c] for c, _ in near]], self.codes.of(np.array([v for _, v in near]))
            off = (a != b).reshape(len(near), MOST, self.width).sum(axis=2)
            met = np.logical_or.accumulate(off <= self.reach, axis=1).mean(axis=0)
            enough = [m for m in range(4, MOST + 1, 4) if met[m - 1] >= recall]
            self.m = enough[0] if enough else MOST
            far = off[:, : self.m].sum(axis=1)[(off[:, : self.m] <= self.reach).any(axis=1)]
            self.radius = int(np.quantile(far, cover, method="higher")) if len(far) else self.m * self.width
            near_head = off[:, : min(self.m, self.head)].sum(axis=1)
            self.head_radius = int(np.quantile(near_head, (1 + cover) / 2, method="higher"))
        self.used = self.m * self.width
        self.nodes = nodes

    def coded(self) -> DataFrame:
        """(cid, asked, subs, code): values of the substrings, and the longs that hold them all."""
        shared = self.nodes.sparkSession.sparkContext.broadcast(self.codes)
        used, width, slot, each = self.used, self.width, self.slot, 64 // self.slot

        def run(batches):
            for b in batches:
                subs = substrings(shared.value.of(_matrix(b.column(2)))[:, :used], width) if b.num_rows else np.zeros((0, used // width), np.int64)
                slots = np.pad(subs, ((0, 0), (0, -subs.shape[1] % each))).reshape(len(subs), -1, each)
                code = (slots << (slot * np.arange(each, dtype=np.int64))).sum(axis=2)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (subs, code)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["cid", "asked", "subs", "code"])

        return self.nodes.select("cid", "asked", "v").mapInArrow(run, "cid long, asked boolean, subs array<long>, code array<long>")

    def meetings(self) -> DataFrame:
        """(qid, cid): pairs of different nodes that meet in a substring and are within the radius, in the first substring they meet in."""
        coded = materialise(self.coded(), "codes")
        each = 64 // self.slot
        lanes = -(-self.m // each)
        heads = range(min(HEAD, lanes))
        long = lambda c, i: F.get(c, F.lit(i))
        off = lambda x, t: F.bit_count(F.shiftrightunsigned(x[t // each], self.slot * (t % each)).bitwiseAND(F.lit((1 << self.slot) - 1)))
        apart = lambda x: sum((F.bit_count(c) for c in x), F.lit(0))
        first = lambda x, m: ~reduce(lambda p, q: p | q, [(F.col("s") > t) & (off(x, t) <= self.reach) for t in range(m)])
        rows = coded.select("cid", *(long("code", i).alias(f"h{i}") for i in heads), F.posexplode("subs").alias("s", "value"))
        asked = coded.filter("asked").select(F.col("cid").alias("qid"), *(long("code", i).alias(f"g{i}") for i in heads), F.posexplode("subs").alias("s", "own"))
        masks = F.expr("array(" + ", ".join(f"{x}L" for x in masks_within(self.width, self.reach)) + ")")
        asked = asked.select("qid", *(f"g{i}" for i in heads), "s", F.explode(F.transform(masks, lambda x: F.col("own").bitwiseXOR(x))).alias("value"))
        # what the first longs of two codes rule out ends in the join of the keys
        head = [F.col(f"h{i}").bitwiseXOR(F.col(f"g{i}")) for i in heads]
        met = asked.join(rows, ["s", "value"]).filter((F.col("qid") != F.col("cid")) & (apart(head) <= self.head_radius) & first(head, min(self.m, self.head))).select("qid", "cid", "s")
        own = small(coded.filter("asked").select(F.col("cid").alias("qid"), F.col("code").alias("own")), F.lit(8 * lanes))
        met = met.join(small(coded.select("cid", "code"), F.lit(8 * lanes)), "cid").join(own, "qid")
        whole = [long("code", i).bitwiseXOR(long("own", i)) for i in range(lanes)]
        return met.filter((apart(whole) <= self.radius) & first(whole, self.m)).select("qid", "cid")


def nearest(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 4096, recall: float = 0.95, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row for which ``queries`` (over vec_id) holds."""
    d = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    lengths = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = d.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    if lengths is None:
        return empty
    d = d.filter(F.size("v") == lengths["n"])
    if not d.groupBy("vec_id").count().filter("count > 1").isEmpty():
        d = d.groupBy("vec_id").agg(F.min("v").alias("v"))
    nodes = materialise(nodes_of(d, queries, k), "nodes")
    n, n_asked = nodes.agg(F.count("*"), F.count_if("asked")).first()
    if not n_asked:
        return empty
    index = Index(nodes, n, k, sample_rows, recall=recall)
    vectors = nodes.select("cid", "v")
    asked = nodes.filter("asked").select(F.col("cid").alias("qid"), F.col("v").alias("q"))
    asked = small(asked, F.lit(8 * lengths["n"]))
    found = index.meetings().join(vectors, "cid").join(asked, "qid").select("qid", "cid", distance(F.col("v"), F.col("q")).alias("score"))
    found = materialise(_best(found, k), "met")
    own = asked.select("qid", F.col("qid").alias("cid"), F.lit(0.0).alias("score"))
    found = found.unionByName(own)
    # a query with too few is compared with all nodes; k nodes and itself are enough, whatever their copies
    counts = found.join(nodes.select("cid", F.size("ids").alias("c")), "cid").groupBy("qid").agg(F.sum("c").alias("c"))
    blocks = max(1, -(-n_asked // block_rows))
    few = asked.join(counts.filter(F.col("c") <= k), "qid", "left_semi").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    few = materialise(few, "few")
    found = found.join(small(few.select("qid"), F.lit(8)), "qid", "left_anti")
    for r in few.select("block").distinct().collect():
        block = few.filter(F.col("block") == r["block"]).collect()
        found = found.unionByName(_best(all_nearest(vectors, np.array([x["qid"] for x in block]), np.array([x["q"] for x in block]), k + 1), k + 1))
    # nodes to ids: the k + 1 nearest ids of a vector serve all queries that have it
    spread = found.join(nodes.select("cid", F.explode("ids").alias("vec_id")), "cid")
    near = spread.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1).select("qid", "vec_id", "score")
    asking = d.filter(queries).select(F.col("vec_id").alias("query_id"), "v").join(nodes.filter("asked").select("v", F.col("cid").alias("qid")), "v").select("query_id", "qid")
    pairs = asking.join(near, "qid").filter("query_id != vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
