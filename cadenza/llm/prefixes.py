"""Op 12: the prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Turns are numbered by range partitions, so a conversation of any
length is many tasks' work, and a prefix is named by two 64-bit numbers: XXH64 hashes of (place, role, text),
combined by exclusive or. Names of ``BAND`` places at a time stand in one row of a conversation.

The trie is peeled from the deepest turn: at each depth the conversations that end there meet the nodes that
survive from below, whose last turn is stripped, and are grouped by name. One aggregation so finds the nodes of
a depth and sums up what lies below them: members, children, leaves, saved tokens. It combines before the
shuffle, so a first turn that a third of all conversations share costs one row a task. A node carries the
names above it for the rest of its band and fetches the next band once.

The number of rounds is the depth of the deepest sequence that two conversations share, to the next band: what
one conversation owns alone is a chain, which is written out at once and enters the peeling as one child.

Conversations that end at a node are listed in blocks of ``BLOCK`` ids; a digest streams over a node's blocks.

Order of turns: turn (null first), then role and text, so ties have one result. Null role or text is empty.
Rows without conv_id belong to no conversation. Extra columns are ignored; an empty table has no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.runtime import materialise, scratch_path

#: Places whose names one row holds, and bits of the ids that one block of ends spans.
BAND, BLOCK = 32, 13
#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"
NAME = ["k1", "k2"]


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, i, role, text), i from 1 in each conversation's order, by counts of its rows in each range partition."""
    x = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).filter("conv is not null")
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    x = x.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    x = materialise(x, "ordered-turns")  # bounds of ranges are sampled
    per = x.groupBy("conv", "p").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("conv", "p", (before - F.col("first") + 1).alias("shift"))
    return x.join(per, ["conv", "p"]).select("conv", (F.col("m") + F.col("shift")).alias("i"), "role", "text")


def rebuilt_turns(numbered: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv, d, role, text) of conversations that begin with h turns of the first of their group, h = crc32(conv) % heads; and (conv, n) with their lengths, 0 included."""
    base = F.col("conv") - F.col("conv") % group
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    size = numbered.groupBy("conv").agg(F.max("i").alias("n"))
    lent = size.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = materialise(size.select("conv", "n", base.alias("base"), h.alias("h")).join(lent, "base", "left").select("conv", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent")), "conversations")
    head = numbered.filter(F.col("i") < heads).select(F.col("conv").alias("base"), F.col("i").alias("d"), "role", "text")
    head = head.join(convs.filter("lent > 0").select("base", "conv", "lent"), "base").filter(F.col("d") <= F.col("lent")).select("conv", "d", "role", "text")
    own = numbered.join(convs.select("conv", "h", "lent"), "conv").filter(F.col("i") > F.col("h"))
    own = own.select("conv", (F.col("lent") + F.col("i") - F.col("h")).alias("d"), "role", "text")
    return head.unionByName(own), convs.select("conv", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def bands(turns: DataFrame, band: int) -> DataFrame:
    """(conv, band, xs): xs holds (name, words of the last text) of each prefix that ends in the band, from turns (conv, d, role, text)."""
    x = turns.select("conv", "d", F.floor((F.col("d") - 1) / band).alias("band"), F.xxhash64("d", "role", "text").alias("h1"), F.xxhash64(F.lit(1), "d", "role", "text").alias("h2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    x = x.groupBy("conv", "band").agg(F.array_sort(F.collect_list(F.struct("d", "h1", "h2", "words"))).alias("xs"), F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    w = W.partitionBy("conv").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("t1", F.coalesce(F.bit_xor("t1").over(w), F.lit(0))).withColumn("t2", F.coalesce(F.bit_xor("t2").over(w), F.lit(0)))

    def upto(total: str, field: str, i: Column) -> Column:
        return F.aggregate(F.slice("xs", F.lit(1), i + 1), F.col(total), lambda s, y: s.bitwiseXOR(y[field]))

    named = F.transform("xs", lambda y, i: F.struct(upto("t1", "h1", i).alias("k1"), upto("t2", "h2", i).alias("k2"), y["words"].alias("words")))
    return x.select("conv", F.col("band").cast("int").alias("band"), named.alias("xs"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the ids (depth, k1, k2, conv) that end at each name, in numeric order."""
    blocks = ends.groupBy("depth", *NAME, F.shiftright("conv", BLOCK).alias("block")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    blocks = blocks.select("depth", *NAME, "block", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        now, digest, done = None, None, []
        schema = pa.schema([("depth", pa.int32()), *((c, pa.int64()) for c in NAME), ("ends_sha256", pa.string())])
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            for key, ids in zip(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), b.column(4).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield emit(done)
                done = []
        if now is not None:
            yield emit([(*now, digest.hexdigest())])

    dealt = blocks.repartition("depth", *NAME).sortWithinPartitions("depth", *NAME, "block").select("depth", *NAME, "block", "ids")
    return dealt.mapInArrow(run, "depth int, k1 long, k2 long, ends_sha256 string")


def owned(names: DataFrame, band: int) -> DataFrame:
    """(conv, cut): the least band end that only this conversation reaches; all from there on is a chain of its own."""
    last = names.filter(F.size("xs") == band).select("conv", ((F.col("band") + 1) * band).alias("depth"), F.col("xs")[band - 1].alias("x"))
    sole = last.groupBy("depth", "x.k1", "x.k2").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).filter("n = 1")
    return sole.groupBy("conv").agg(F.min("depth").alias("cut"))


def peel(turns: DataFrame, sizes: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of the trie of conversations sizes(conv, n) with turns (conv, d, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = turns.sparkSession
    names = materialise(bands(turns, band), "bands")
    longest = sizes.agg(F.max("n")).first()[0]
    cuts = materialise(owned(names, band), "owned") if (longest or 0) > band else names.select("conv", F.lit(0).alias("cut")).limit(0)
    # a conversation enters where it ends, or, as a child of its depth, above what it owns alone
    enters = sizes.join(cuts, "conv", "left").select("conv", "n", F.col("cut").isNotNull().alias("child"), F.coalesce(F.col("cut") - 1, F.col("n")).cast("int").alias("depth"))
    enters = enters.withColumn("band", F.floor((F.col("depth") - 1) / band).cast("int"))
    enters = enters.join(names, ["conv", "band"], "left").select("conv", "n", "child", "depth", F.slice(F.coalesce("xs", F.array()), F.lit(1), F.greatest(F.col("depth") - F.col("band") * band, F.lit(0))).alias("rest"))
    enters = materialise(enters, "enters")

    path = scratch_path(spark, "nodes")
    deepest = enters.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        got = enters.filter(F.col("depth") == depth).select("conv", F.lit(1).cast("long").alias("n_convs"), F.col("child").cast("long").alias("n_children"), F.col("child").cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "rest")
        if below is not None:
            stripped = below.withColumn("rest", F.slice("rest", F.lit(1), F.size("rest") - 1))
            if depth and depth % band == 0:  # the names of the band above
                above = names.filter(F.col("band") == depth // band - 1).select("conv", "xs")
                stripped = stripped.drop("rest").join(above, "conv").withColumnRenamed("xs", "rest")
            got = got.unionByName(stripped.select("conv", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", "rest"))
        top = F.element_at("rest", -1) if depth else F.struct(*(F.lit(0).cast("long").alias(c) for c in (*NAME, "words")))
        got = got.withColumn("x", top).groupBy(F.col("x.k1").alias("k1"), F.col("x.k2").alias("k2"))
        got = got.agg(F.min(F.struct("conv", "rest")).alias("first"), F.max("x.words").alias("words"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
        node = got.select("first.conv", *NAME, "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), "first.rest")
        node.write.option("compression", "zstd").parquet(f"{path}/depth={depth}")
        below = spark.read.schema(node.schema).parquet(f"{path}/depth={depth}")
    if below is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    nodes = spark.read.schema(below.drop("rest").schema.add("depth", "integer")).parquet(path).select("depth", *NAME, "conv", "n_convs", "n_children", "n_leaves", "saved_tokens")
    tails = names.join(cuts, "conv").select("conv", "cut", "band", F.posexplode("xs").alias("at", "x")).withColumn("depth", (F.col("band") * band + F.col("at") + 1).cast("int")).filter(F.col("depth") >= F.col("cut"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = tails.join(sizes, "conv").select("depth", "x.k1", "x.k2", "conv", one.alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"))
    return with_parents(nodes.unionByName(tails), names, sizes, band)


def with_parents(nodes: DataFrame, names: DataFrame, sizes: DataFrame, band: int) -> DataFrame:
    """nodes with the smallest member of their parents and the digest of the conversations that end at them."""
    nodes = materialise(nodes, "trie")
    # the name above each node, by its smallest member
    x = names.select("conv", "band", F.posexplode("xs").alias("at", "x")).select("conv", (F.col("band") * band + F.col("at") + 1).cast("int").alias("depth"), "x.k1", "x.k2")
    top = sizes.select("conv", F.lit(0).alias("depth"), none_long().alias("k1"), none_long().alias("k2"))
    x = x.unionByName(top)
    above = x.select("conv", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(above, ["conv", "depth"], "left").join(parents, ["depth", "u1", "u2"], "left").drop("u1", "u2")
    ends = sizes.select("conv", F.col("n").cast("int").alias("depth")).join(x, ["conv", "depth"]).select("depth", *NAME, "conv")
    out = out.join(end_digests(ends), ["depth", *NAME], "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def none_long() -> Column:
    return F.lit(0).cast("long")


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", band: int = BAND) -> DataFrame:
    """The prefix trie of the conversations of a table as they are."""
    numbered = materialise(numbered_turns(turns, conv_col, turn_col, role_col, text_col), "turns")
    sizes = materialise(numbered.groupBy("conv").agg(F.max("i").alias("n")), "sizes")
    return peel(numbered.withColumnRenamed("i", "d"), sizes, band)


def rebuilt_trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """The prefix trie of conversations that each begin with turns of the first of their group of twenty."""
    numbered = materialise(numbered_turns(turns, "conv_id", "turn", "role", "text"), "turns")
    rebuilt, sizes = rebuilt_turns(numbered)
    return peel(rebuilt, materialise(sizes, "sizes"), band)
