"""Op 8: removal of boilerplate lines that spread over many distinct sites. DataFrame functions only.

A HyperLogLog sketch of the sites of each line hash merges by map-side aggregation, so a line of any
frequency costs one small state a task. Lines whose estimate lies near the threshold get an exact
distinct count; estimates beyond twice or below half of it decide alone (far outside the sketch's
error, and such small counts are stored exactly in it). The first occurrence of a boilerplate line, by
(doc_id, line number), stays; all others go.

A site is ``site_col``; null is no site. Null text has no lines and stays null; other text keeps its
empty and short lines (under ``min_chars`` characters), which are never boilerplate. Rows that repeat a
doc_id are judged each by their own text; where such rows hold the first occurrence, each keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.runtime import materialise


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """One narrow row per eligible line: rid (of the row), doc, line number, two hashes of the line, site."""
    d = docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.col(id_col).alias("doc"), F.col(site_col).cast("string").alias("site"), F.split(text_col, "\n").alias("ls"))
    x = d.select("rid", "doc", "site", F.posexplode("ls").alias("no", "line")).filter(F.length("line") >= min_chars)
    return x.select("rid", "doc", "site", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """(h1, h2, first) of the lines on at least min_sites distinct sites; first is their earliest (doc, no)."""
    key = ["h1", "h2"]
    seen = lines.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("est"), F.min(F.struct("doc", "no")).alias("first"))
    # stored and small: joins with it are broadcast by its size, or split where a line is very common
    seen = materialise(seen.filter(F.col("est") * 2 >= min_sites), "spread-lines")
    sure = seen.filter(F.col("est") > 2 * min_sites).select(*key, "first")
    near = seen.filter(F.col("est") <= 2 * min_sites).select(*key, "first")
    pairs = lines.filter(F.col("site").isNotNull()).join(near.select(*key), key, "left_semi").select(*key, "site").distinct()
    exact = pairs.groupBy(*key).count().filter(F.col("count") >= min_sites).select(*key)
    return sure.unionByName(near.join(exact, key, "left_semi"))


def _kept(text: Column, gone: Column) -> Column:
    at = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(at) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(at, i)), "\n")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_chars: int = 10) -> DataFrame:
    """docs with text_col rid of boilerplate lines, plus __n_lines and __n_removed."""
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    bad = materialise(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.select("rid", "doc", "no", "h1", "h2").join(bad, ["h1", "h2"])
    hits = hits.filter(~(F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.no") == F.col("no"))))
    # a row is known by its id and the hash of id and text
    gone = hits.groupBy("rid", "doc").agg(F.collect_set("no").alias("__gone")).select(F.col("rid").alias("__rid"), F.col("doc").alias("__doc"), "__gone")
    own = F.xxhash64(docs[id_col], docs[text_col]) == F.col("__rid")
    out = docs.join(gone, own & docs[id_col].eqNullSafe(F.col("__doc")), "left").drop("__rid", "__doc")
    out = out.withColumn("__n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n"))).cast("long"))
    out = out.withColumn("__n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(_kept(F.col(text_col), F.col("__gone")))).drop("__gone")
