"""Joins of logs, labels, catalogues, intervals and sampled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.runtime import few, materialise


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")


def label_cascade(log: DataFrame, labels: DataFrame, valid: tuple[str, ...] = ("speech", "non_speech", "noisy_speech")) -> DataFrame:
    """log(source_id, occurrence, text, ...) with the label by (source, occurrence), else (source, text) if text isn't empty, else source.

    labels(line_no, source_id, label, text, occurrence_index); later lines win. A source that has a keyed
    label is not labelled as a whole. Rows without a label or with an invalid one go.
    """
    by_occ = last_wins(labels.filter("occurrence_index is not null"), ["source_id", "occurrence_index"], "line_no").select("source_id", F.col("occurrence_index").alias("occurrence"), F.col("label").alias("l1"))
    by_text = last_wins(labels.filter("occurrence_index is null and coalesce(text, '') != ''"), ["source_id", "text"], "line_no").select("source_id", "text", F.col("label").alias("l2"))
    keyed = labels.filter("occurrence_index is not null or coalesce(text, '') != ''").select("source_id").distinct()
    whole = last_wins(labels.filter("occurrence_index is null and coalesce(text, '') = ''"), ["source_id"], "line_no").join(keyed, "source_id", "left_anti").select("source_id", F.col("label").alias("l3"))
    out = log.join(by_occ, ["source_id", "occurrence"], "left").join(by_text, ["source_id", "text"], "left").join(whole, "source_id", "left")
    return out.withColumn("label", F.coalesce("l1", F.when(F.col("text") != "", F.col("l2")), "l3")).drop("l1", "l2", "l3").filter(F.col("label").isin(*valid))


def pairs_by_path(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Speech rows of a with b's row of the same path (the last one), errors on either side left out."""
    right = last_wins(b, ["path"], order).filter("not error").select("path", F.col("text").alias("text_b"))
    return a.filter("not error and label != 'non_speech'").select("path", F.col("text").alias("text_a")).join(right, "path")


def inside_segments(frames: DataFrame, segments: DataFrame, width: float, key: str = "source_id") -> DataFrame:
    """Frames whose time lies in [start, end) of a segment of their key: an equi-join on time cells of ``width`` and a range test.

    frames(key, t, ...); segments(key, segment, start, end). A segment covers (end - start) / width + 1 cells at most.
    """
    cells = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
    s = segments.filter(F.col("end") > F.col("start")).withColumn("cell", F.explode(cells))
    return frames.withColumn("cell", F.floor(F.col("t") / width)).join(s, [key, "cell"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("cell")


def stride_position(i: Column, n: Column, pool: Column) -> Column:
    """Place of the i-th (from 0) of n samples over a pool: even stride, half to even; repeats evenly beyond the pool; the first if n is 1."""
    even = F.when(n > 1, F.bround(i * (pool - 1) / F.greatest(n - 1, F.lit(1)))).otherwise(0)
    return F.when(n <= pool, even).otherwise(F.floor(i * pool / n)).cast("long")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with consecutive numbers from 0 by order, without gathering it in one task: counts per range partition are added up first.

    The ranges are stored, since bounds are sampled and would differ between two evaluations.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    d = materialise(d, "ranges")
    per = d.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    base = per.withColumn("__base", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__first", "__base")
    return d.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__first", "__base")


def compatible(df: DataFrame, engines: DataFrame, language: str = "language") -> DataFrame:
    """df(engine_id, language) rows whose engine supports the language; engines without a list and unknown ones support all."""
    e = few(engines.select("engine_id", "languages"))
    return df.join(e, "engine_id", "left").filter(F.coalesce(F.array_contains("languages", F.col(language)), F.lit(True))).drop("languages")


def preset_for(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """requests(vad, lang, engine) with the score of exactly that preset, or of the best of (vad, lang) where engine is null."""
    exact = presets.select("vad", "lang", "engine", F.col("score").alias("s1"))
    best = presets.groupBy("vad", "lang").agg(F.min_by(F.struct("engine", "score"), F.struct("score", "engine")).alias("b"))
    out = requests.join(exact, ["vad", "lang", "engine"], "left").join(best, ["vad", "lang"], "left")
    own = F.col("engine").isNotNull()
    return out.select("vad", "lang", F.col("engine").alias("asked"), F.when(own, F.when(F.col("s1").isNotNull(), F.col("engine"))).otherwise(F.col("b.engine")).alias("engine"), F.when(own, F.col("s1")).otherwise(F.col("b.score")).alias("score"))


def upsert(old: DataFrame, new: DataFrame, replace_dataset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, counts): new rows replace those of equal path; with replace_dataset, that dataset's old rows go first. counts: added, updated, removed."""
    base = old if replace_dataset is None else old.filter(~F.coalesce(F.col("source_dataset") == replace_dataset, F.lit(False)))
    merged = base.join(new.select("path"), "path", "left_anti").unionByName(new)
    flags = base.select("path", F.lit(1).alias("o")).join(new.select("path", F.lit(1).alias("n")), "path", "full")
    counts = flags.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("updated"))
    gone = F.lit(0) if replace_dataset is None else F.coalesce(F.lit(old.count() - base.count()), F.lit(0))
    return merged, counts.withColumn("removed", gone.cast("long"))
