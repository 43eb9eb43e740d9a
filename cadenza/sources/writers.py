"""Writers of subtitles, result tables, manifests, reports and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.text import stamp
from cadenza.runtime import materialise


#: Blocks that one subtitle file holds at most.
BLOCKS_PER_FILE = 100_000


def srt_rows(subtitles: DataFrame, translated: bool = False, key: str = "source_id") -> DataFrame:
    """(key, idx, block): a row for each of subtitles(idx, start_time, end_time, text, translated_text); indices keep their gaps.

    translated: only rows with a translation, under their own index.
    """
    s = subtitles.filter(F.coalesce(F.col("translated_text"), F.lit("")) != "") if translated else subtitles
    text = F.col("translated_text" if translated else "text")
    return s.select(key, "idx", F.concat(F.col("idx").cast("string"), F.lit("\n"), stamp("start_time"), F.lit(" --> "), stamp("end_time"), F.lit("\n"), text, F.lit("\n")).alias("block"))


def write_srt(subtitles: DataFrame, path: str, translated: bool = False, most: int = BLOCKS_PER_FILE) -> None:
    """Subtitles of each source in a folder of its own, in files of ``most`` blocks at most whose names are in the order of their blocks.

    Blocks are dealt by ranges of (source, index) and stream through tasks in order, so a source of any length is many
    tasks' work and never one row; a task's files appear when it commits, by names that its retry writes again. Tasks move
    their files themselves (version 2 of the committer): with a folder a source the driver would else move each one.
    """
    rows = srt_rows(subtitles, translated).repartitionByRange("source_id", "idx").sortWithinPartitions("source_id", "idx")
    rows.select("source_id", F.col("block").alias("value")).write.partitionBy("source_id").option("maxRecordsPerFile", most).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)


#: What opening a file counts as in bytes: files of subtitles are small and many, and a task takes some hundred.
OPEN_COST = "spark.sql.files.openCostInBytes"


def _many_files(rows: DataFrame, name: str) -> DataFrame:
    """rows, read here from many small files, as a stored table."""
    spark = rows.sparkSession
    old = spark.conf.get(OPEN_COST, None)
    spark.conf.set(OPEN_COST, "64k")
    try:
        return materialise(rows, name)
    finally:
        spark.conf.set(OPEN_COST, old) if old else spark.conf.unset(OPEN_COST)


def read_srt_files(spark: SparkSession, path: str, key: str = "source_id") -> DataFrame:
    """(key, srt) of what write_srt has written: a source's files, whole and in order, as one text that ends with its last block."""
    back = spark.read.schema(f"value string, {key} long").text(path, wholetext=True)
    files = F.array_sort(F.collect_list(F.struct(F.col("_metadata.file_name").alias("name"), "value")))
    whole = back.groupBy(key).agg(F.array_join(F.transform(files, lambda f: f["value"]), "").alias("srt"))
    return _many_files(whole.select(key, F.regexp_replace("srt", r"\n\z", "").alias("srt")), "srt-files")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, idx, block) of what write_srt has written; a blank line ends a block."""
    back = spark.read.schema("value string, source_id long").option("lineSep", "\n\n").text(path)
    return _many_files(back.select("source_id", F.element_at(F.split("value", "\n", 2), 1).cast("long").alias("idx"), F.concat("value", F.lit("\n")).alias("block")), "srt-blocks")


def result_rows(results: DataFrame) -> DataFrame:
    """Result rows as the CSV holds them: four decimals, two for the duration, blank for null."""
    shown = lambda c, f: F.coalesce(F.format_string(f, F.col(c)), F.lit("")) if c else None
    text = lambda c, f: F.when(F.col(c).isNull(), "").otherwise(shown(c, f)).alias(c)
    return results.select("engine", "language", "file_id", *(text(c, "%.4f") for c in ("cer", "wer", "rtf")), text("duration", "%.2f").alias("duration_sec"))


def write_results(results: DataFrame, path: str) -> None:
    """One folder of CSV files per engine and language."""
    result_rows(results).write.partitionBy("engine", "language").option("header", True).csv(path)


def value_counts(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n): samples by value of each key; a missing value is ``__none__``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("__none__")).alias("value")) for k in keys)))
    return samples.select(pairs.alias("kv")).groupBy("kv.key", "kv.value").agg(F.count("*").alias("n"))


def report(sweep: DataFrame, recommended: DataFrame, counts: DataFrame, breakdown: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """One JSON row: counts by label, the recommended row, the sweep in order of threshold, and the breakdown map.

    breakdown (key, value, threshold, ...) and values (key, value, n) give for every key its value counts and
    the sweep of each value. Grid and values bound the size.
    """
    metrics = ["threshold", *[c for c in sweep.columns if c != "threshold"]]
    in_order = F.array_sort(F.collect_list(F.struct(*metrics)))
    one = F.lit(1).alias("k")
    s = sweep.agg(in_order.alias("sweep"), one)
    c = counts.agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("samples"), one)
    r = recommended.select(F.struct(*metrics).alias("recommended"), one)
    parts = ["samples", "recommended", "sweep"]
    out = s.join(c, "k").join(r, "k")
    if breakdown is not None and values is not None:
        each = breakdown.groupBy("key", "value").agg(in_order.alias("rows")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "rows"))).alias("sweep_by_value"))
        n = values.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("value_counts"))
        b = n.join(each, "key", "left").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("key", "value_counts", "sweep_by_value")))).alias("breakdown"), one)
        out, parts = out.join(b, "k"), [*parts, "breakdown"]
    return out.select(F.to_json(F.struct(*parts)).alias("report"))


def comparison(studies: DataFrame, keys: list[str], fixed: list[str], names: list[str] | None = None) -> DataFrame:
    """One row per study with its fixed columns, then sorted param_ columns of the params map; missing cells are blank."""
    names = sorted(names if names is not None else [r[0] for r in studies.select(F.explode(F.map_keys("params"))).distinct().collect()])  # one row a parameter
    cell = lambda n: F.coalesce(F.try_element_at("params", F.lit(n)).cast("string"), F.lit("")).alias(f"param_{n}")
    return studies.select(*keys, *fixed, *(cell(n) for n in names))


def shown(c: Column, digits: int) -> Column:
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{digits}f", c))
