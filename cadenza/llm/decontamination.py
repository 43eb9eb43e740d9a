"""Op 1: benchmark decontamination over a distributed positional inverted index. DataFrame functions only.

``build_index`` stores postings (term, document, position), dealt by term with a salt for frequent
terms and sorted, so posting lists are contiguous on storage. ``phrase_hits`` takes the rarest terms of
every benchmark window, shifts their posting lists by the term's place in the item and intersects them:
what is left is (document, item, diagonal), one row for a whole shared passage. Only documents with such
a row are read again, and there the item's words are compared along the diagonal, so results are exact.
``proximity_hits`` finds documents where all given terms lie within a span, in any order.

Words are maximal runs of a-z (A-Z lower-cased), 0-9 and non-ASCII characters. Null text has no words.
Items of null text, no words or null item_id take no part; repeated item rows count once. Repeated
document rows get equal results. An empty benchmark hits nothing; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import ascii_lower, fits, small
from cadenza.runtime import materialise

BREAKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Parts that a term's posting list is dealt to.
SALT = 32


def words(text: Column) -> Column:
    t = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(BREAKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BREAK))


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("rid"))


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("rid", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def _within(tokens: DataFrame, terms: DataFrame | None) -> DataFrame:
    """Tokens whose term is among terms; those are broadcast if they are few."""
    return tokens if terms is None else tokens.join(small(terms, F.octet_length("term")), "term")


def term_counts(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n): occurrences of each term over all documents."""
    return _within(_tokens(_docs(docs, id_col, text_col)).select("term"), terms).groupBy("term").agg(F.count("*").alias("n"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (term, rid, pos) of all terms, or of the given ones; rid is the row's hash of id and text."""
    rows = _within(_tokens(_docs(docs, id_col, text_col)), terms).select("term", "rid", "pos")
    rows = rows.repartition("term", F.pmod("rid", F.lit(SALT))).sortWithinPartitions("term", "rid", "pos")
    return materialise(rows, "postings")


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(ik, item_id, iw): the words of every item that has an id and words."""
    b = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter("item_id is not null").distinct()
    return b.select(F.xxhash64("item_id", "text").alias("ik"), "item_id", words(F.col("text")).alias("iw")).filter(F.size("iw") > 0)


def anchors_of(items: DataFrame, counts: DataFrame, window: int, rarest: int = 2) -> DataFrame:
    """(term, ik, ipos): the rarest terms of every window whose terms all occur. Work of the benchmark's size."""
    at = items.select("ik", F.size("iw").alias("n"), F.posexplode("iw").alias("ipos", "term")).join(counts, "term", "left")
    size = F.least(F.col("n"), F.lit(window))
    first, last = F.greatest(F.col("ipos") - size + 1, F.lit(0)), F.least(F.col("ipos"), F.col("n") - size)
    each = at.select("ik", "ipos", "term", F.coalesce("c", F.lit(0)).alias("c"), F.explode(F.sequence(first, last)).alias("start"))
    w = W.partitionBy("ik", "start")
    ranked = each.withColumn("least", F.min("c").over(w)).withColumn("r", F.row_number().over(w.orderBy("c", "ipos")))
    return ranked.filter((F.col("least") > 0) & (F.col("r") <= rarest)).select("term", "ik", "ipos").distinct()


def phrase_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row that holds a window: rid and doc_id (which name it together), hit (its word positions), items (ids of items with occurring windows)."""
    items = materialise(items_of(benchmark, item_col, item_text_col), "items")
    vocabulary = items.select(F.explode("iw").alias("term")).distinct()
    counts = materialise(term_counts(docs, vocabulary, id_col, text_col).withColumnRenamed("n", "c"), "term-counts")
    anchors = materialise(anchors_of(items, counts, window), "anchors")
    index = build_index(docs, anchors.select("term").distinct(), id_col, text_col)
    # offset-adjusted lists meet where document position - item position agree
    lists = _lists(index, anchors).groupBy("rid", "ik", (F.col("pos") - F.col("ipos")).alias("diag")).agg(F.count("*").alias("lists"))
    seeds = lists.groupBy("rid", "ik").agg(F.collect_list(F.struct("diag", "lists")).alias("ds")).join(small(items, F.octet_length(F.array_join("iw", ""))), "ik")
    # an item's words go along once a document, whatever the number of its diagonals
    diags = F.transform(F.filter("ds", lambda d: (d["lists"] > 1) | (F.size("iw") == 1)), lambda d: d["diag"])
    seeds = seeds.select("rid", "item_id", "iw", diags.alias("diags")).filter(F.size("diags") > 0)
    found = seeds.groupBy("rid").agg(F.collect_list(F.struct("item_id", "iw", "diags")).alias("found"))
    texts = _docs(docs, id_col, text_col)
    # the words are bound once for a document, not split anew for every candidate
    bound = F.array(F.struct(words(F.col("text")).alias("dw"), F.col("found").alias("fs")))
    along = lambda b, f: F.array_distinct(F.flatten(F.transform(f["diags"], lambda d: _along(b["dw"], f["iw"], d, window))))
    match = lambda b: F.transform(b["fs"], lambda f: F.struct(f["item_id"].alias("item_id"), along(b, f).alias("at")))
    d = found.join(texts, "rid").select("rid", "doc_id", F.get(F.transform(bound, match), F.lit(0)).alias("m")).dropDuplicates(["rid", "doc_id"])
    d = d.select("rid", "doc_id", F.filter("m", lambda f: F.size(f["at"]) > 0).alias("m")).filter(F.size("m") > 0)
    return d.select("rid", "doc_id", F.array_distinct(F.flatten(F.col("m.at"))).alias("hit"), F.array_distinct(F.col("m.item_id")).alias("items"))


def _lists(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Postings with the anchors of their term; anchors that are no broadcast meet a frequent term's list part by part."""
    if fits(anchors, F.octet_length("term")):
        return index.join(F.broadcast(anchors), "term")
    parts = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return index.withColumn("salt", F.pmod("rid", F.lit(SALT)).cast("int")).join(parts, ["term", "salt"])


def _along(dw: Column, iw: Column, diag: Column, window: int) -> Column:
    """Document positions within windows of the item's words that the document holds on the diagonal."""
    n = F.size(iw)
    size = F.least(n, F.lit(window))
    bits = F.array_join(F.transform(iw, lambda w, j: F.when((diag + j >= 0) & F.get(dw, F.greatest(diag + j, F.lit(0))).eqNullSafe(w), "1").otherwise("0")), "")
    starts = F.filter(F.sequence(F.lit(0), n - size), lambda s: F.substring(bits, s + 1, size) == F.repeat(F.lit("1"), size))
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(diag + s, diag + s + size - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    hits = phrase_hits(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    hits = hits.select("rid", F.col("doc_id").alias("hit_id"), F.size("hit").alias("n_hit"), F.size("items").alias("n_items"), F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").alias("ids"))
    d = _docs(docs, id_col, text_col).select("doc_id", "rid", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = d.join(hits, (d["rid"] == hits["rid"]) & d["doc_id"].eqNullSafe(hits["hit_id"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark window."""
    hit = phrase_hits(docs, benchmark, window, id_col, text_col).select(F.col("rid").alias("__hit"), F.col("doc_id").alias("__hit_id"))
    return docs.join(hit, (F.xxhash64(docs[id_col], docs[text_col]) == F.col("__hit")) & docs[id_col].eqNullSafe(F.col("__hit_id")), "left_anti")


def proximity_hits(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """(phrase_id, rid) where all terms of a phrase (phrase_id, terms array) lie within span consecutive words.

    Cells of 2 * span words overlap by half, so every stretch of span words lies in one; a phrase's
    postings meet by cell, never by whole document.
    """
    want = phrases.select("phrase_id", F.array_distinct("terms").alias("terms")).filter(F.size("terms") > 0)
    each = want.select("phrase_id", F.size("terms").alias("k"), F.explode("terms").alias("term"))
    at = index.join(each, "term")
    cell = F.floor(F.col("pos") / span)
    cells = at.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    key = ["phrase_id", "rid", "cell"]
    whole = cells.groupBy(*key).agg(F.count_distinct("term").alias("seen"), F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("ps"))
    ends = whole.filter("seen = k").withColumn("p", F.explode("ps"))
    inside = ends.filter(F.size(F.array_distinct(F.transform(F.filter("ps", lambda x: (x["pos"] <= F.col("p.pos")) & (x["pos"] > F.col("p.pos") - span)), lambda x: x["term"]))) == F.col("k"))
    return inside.select("phrase_id", "rid").distinct()
