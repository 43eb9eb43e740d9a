"""Registration of queries with their DuckDB twins, and the deterministic views they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f under name; views named in sql (v_...) are put before it."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = counted(with_views(sql))
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to 6 places, so that sums in another order compare equal; a zero has no sign."""
    name = name or (c if isinstance(c, str) else None)
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*(r6(f.name, f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


# Views ------------------------------------------------------------------------------------------

SQL: dict[str, str] = {}

SQL["v_samples"] = """
SELECT doc_id, label, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE len(list_distinct(w)) / len(w) END signal, lang, source,
       CASE WHEN label = 'noisy_speech' THEN doc_id % 5 END snr, text, n_chars, doc_id % 23 = 0 AS error
FROM (SELECT d.*, string_split(text, ' ') w, CASE WHEN quality = 0 THEN 'non_speech' WHEN toxic = 1 THEN 'noisy_speech' ELSE 'speech' END label
      FROM documents d JOIN labels USING (doc_id))
"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled samples: signal is the share of distinct words, null for every 17th document."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    label = F.when(F.col("quality") == 0, "non_speech").when(F.col("toxic") == 1, "noisy_speech").otherwise("speech")
    w = F.split("text", " ")
    signal = F.when(F.col("doc_id") % 17 != 0, F.size(F.array_distinct(w)) / F.size(w))
    d = d.select("doc_id", label.alias("label"), signal.alias("signal"), "lang", "source", "text", "n_chars", (F.col("doc_id") % 23 == 0).alias("error"))
    return d.withColumn("snr", F.when(F.col("label") == "noisy_speech", F.col("doc_id") % 5))


SQL["v_frames"] = """
SELECT user_id source_id, frame_idx, least(value / 100, 1) p, (frame_idx + 1) * 0.032::DOUBLE ts_s, value, ts, event_id, event_type
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 frame_idx FROM events)
"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Scored frames: one series per user, 32 ms a frame, stamped with the frame's end."""
    e = table(spark, sf, "events")
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = e.withColumn("frame_idx", idx.cast("long"))
    return e.select(F.col("user_id").alias("source_id"), "frame_idx", F.least(F.col("value") / 100, F.lit(1.0)).alias("p"), ((F.col("frame_idx") + 1) * 0.032).alias("ts_s"), "value", "ts", "event_id", "event_type")


SQL["v_utt"] = """
SELECT source_id, turn, text, start_time, start_time + 0.1::DOUBLE * length(text) end_time, 1 / (1 + turn % 100) confidence, CASE WHEN source_id % 2 = 0 THEN 'en' END AS language, turn % 4 <> 3 is_final, role
FROM (SELECT source_id, t * 100000 + j turn, array_to_string(w[j * s + 1:j * s + s], ' ') AS text, t * 300000.0::DOUBLE + j * 3.0::DOUBLE start_time, role
 FROM (SELECT conv_id source_id, turn t, role, 1 + turn % 3 s, string_split(text, ' ') w, unnest(range((len(string_split(text, ' ')) + turn % 3) // (1 + turn % 3))) j FROM conversations))
"""


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised utterances: every turn in pieces of one to three words, three seconds apart; turns lie far apart."""
    size = (1 + F.col("turn") % 3).cast("int")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("t"), "role", size.alias("s"), F.split("text", " ").alias("w"))
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / F.col("s")).cast("int")), lambda j: F.array_join(F.slice("w", j * F.col("s") + 1, F.col("s")), " ")))
    c = c.select("source_id", "t", "role", pieces.alias("j", "text"))
    c = c.select("source_id", (F.col("t") * 100_000 + F.col("j")).cast("long").alias("turn"), "text", (F.col("t") * 300_000.0 + F.col("j") * 3.0).alias("start_time"), "role")
    return c.select("*", (F.col("start_time") + 0.1 * F.length("text")).alias("end_time"), (1 / (1 + F.col("turn") % 100)).alias("confidence"), F.when(F.col("source_id") % 2 == 0, "en").alias("language"), (F.col("turn") % 4 != 3).alias("is_final"))


SQL["v_results"] = """
SELECT l_orderkey * 10 + l_linenumber result_id, l_orderkey file_id, 'e' || (l_suppkey % 5) AS engine, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_linestatus END vad,
       CASE WHEN l_returnflag = 'A' THEN 'ja' ELSE 'en' END AS language, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END wer, l_tax cer,
       l_quantity duration, l_extendedprice / 100000 proc_time, l_extendedprice / 1000 gpu_mb, l_linenumber, l_returnflag, l_linestatus, l_partkey,
       l_extendedprice / 100000 / l_quantity rtf
FROM lineitem
"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark run results, one per line item."""
    d = table(spark, sf, "lineitem")
    return d.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"), F.col("l_orderkey").alias("file_id"), F.concat(F.lit("e"), (F.col("l_suppkey") % 5).cast("string")).alias("engine"),
        F.when(F.col("l_linenumber") != 6, F.col("l_linestatus")).alias("vad"), F.when(F.col("l_returnflag") == "A", "ja").otherwise("en").alias("language"),
        F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("wer"), F.col("l_tax").alias("cer"), F.col("l_quantity").alias("duration"), (F.col("l_extendedprice") / 100000).alias("proc_time"),
        (F.col("l_extendedprice") / 1000).alias("gpu_mb"), "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", (F.col("l_extendedprice") / 100000 / F.col("l_quantity")).alias("rtf"),
    )


def whole(c: Column | str, unit: float) -> Column:
    """c in whole units: sums of such numbers are exact in any order, which sums of doubles are not."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * unit + 0.5)


def places6(c: Column, unit: float = 1.0) -> Column:
    """A mean of whole units at six places; halves go up, by the same arithmetic as in the twin."""
    return F.floor(c / (unit / 1e6) + 0.5) / 1e6


mean6 = "floor(avg(floor({} * 1e9 + 0.5)::BIGINT) / 1e3 + 0.5) / 1e6".format
rest6 = "floor((1e9 - avg(floor({} * 1e9 + 0.5)::BIGINT)) / 1e3 + 0.5) / 1e6".format
SQL["v_cells"] = f"""
SELECT CASE WHEN l_linenumber = 1 THEN 'baseline_off' ELSE 'p' || l_linenumber END preset, l_linestatus backend, engine, l_returnflag corpus,
       {mean6('wer')} false_trigger, {rest6('cer')} recall, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE {rest6('wer')} END short_recall, {mean6('rtf')} hallucination, {mean6('proc_time')} latency
FROM v_results GROUP BY l_linenumber, l_linestatus, engine, l_returnflag
"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Sweep cells: results averaged by preset, backend, engine and corpus, at six places."""
    mean = lambda c: F.avg(whole(c, 1e9))
    of = {"false_trigger": mean("wer"), "recall": 1e9 - mean("cer"), "sr": 1e9 - mean("wer"), "hallucination": mean("rtf"), "latency": mean("proc_time")}
    g = results(spark, sf).groupBy("l_linenumber", "l_linestatus", "engine", "l_returnflag").agg(*(places6(c, 1e9).alias(n) for n, c in of.items()))
    preset = F.when(F.col("l_linenumber") == 1, "baseline_off").otherwise(F.concat(F.lit("p"), F.col("l_linenumber").cast("string")))
    return g.select(preset.alias("preset"), F.col("l_linestatus").alias("backend"), "engine", F.col("l_returnflag").alias("corpus"), "false_trigger", "recall", F.when(F.col("l_linenumber") % 3 != 0, F.col("sr")).alias("short_recall"), "hallucination", "latency")


SQL["v_audio"] = "SELECT vec_id clip, label, [x::DOUBLE FOR x IN embedding] samples FROM embeddings"


def audio(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of 64 samples at 64 Hz."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip"), "label", F.col("embedding").cast("array<double>").alias("samples"))


SQL["v_class"] = "SELECT 'c' || label clip, vec_id win, label % 2 = 1 negative, label % 3 = 0 is_short, [abs(x::DOUBLE) FOR x IN embedding] probs FROM embeddings"


def class_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Class scores of the windows of ten clips."""
    e = table(spark, sf, "embeddings")
    probs = F.transform(F.col("embedding").cast("array<double>"), F.abs)
    return e.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("clip"), F.col("vec_id").alias("win"), (F.col("label") % 2 == 1).alias("negative"), (F.col("label") % 3 == 0).alias("is_short"), probs.alias("probs"))


SQL["v_pairs"] = r"""
SELECT doc_id, piece, lang, source, array_to_string(w, ' ') ref, array_to_string(flatten([CASE WHEN i % 7 = 0 THEN [] WHEN i % 11 = 0 THEN [w[i], w[i]] ELSE [w[i]] END FOR i IN generate_series(1, len(w))]), ' ') hyp
FROM (SELECT doc_id, lang, source, piece, ws[piece * 60 + 1:piece * 60 + 60] w FROM (SELECT doc_id, lang, source, ws, unnest(range((len(ws) + 59) // 60)) piece FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[a-z0-9]+') ws FROM documents)))
"""


def dealt(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df on all cores before costly work on its rows: a table of fewer splits than cores is dealt evenly, others stay as they are."""
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 2 * cores else df.repartition(4 * cores)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Reference and hypothesis of every utterance of 60 words that a document holds; in the hypothesis every 7th word is dropped and every other 11th doubled."""
    d = dealt(spark, table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    d = d.select("doc_id", "lang", "source", F.explode(F.array(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("ws")).filter(F.size("ws") > 0)
    d = d.select("doc_id", "lang", "source", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ws"), F.lit(60)), lambda i: F.slice("ws", i, 60))).alias("piece", "w"))
    hyp = F.transform("w", lambda x, i: F.when((i + 1) % 7 == 0, None).when((i + 1) % 11 == 0, F.concat(x, F.lit(" "), x)).otherwise(x))  # nulls are not joined
    return d.select("doc_id", F.col("piece").cast("long").alias("piece"), "lang", "source", F.array_join("w", " ").alias("ref"), F.array_join(hyp, " ").alias("hyp"))


SQL["v_signals"] = """
SELECT event_id, user_id source_id, ts, event_type, value, CASE WHEN event_id % 3 = 0 THEN value / 200 END no_speech_prob, CASE WHEN event_id % 3 = 1 THEN (value - 20) / 1000 END token_confidence_mean,
       CASE WHEN event_id % 3 <> 1 THEN -value / 100 END avg_logprob, CASE event_id % 4 WHEN 0 THEN 'ReazonSpeech K2 v2' WHEN 1 THEN 'Qwen3-ASR 0.6B' WHEN 2 THEN 'NVIDIA Parakeet TDT CTC 0.6B JA' ELSE 'WhisperS2T base' END engine_name,
       CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS text, event_id % 4 = 3 is_interim
FROM events
"""


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised segments with nullable confidence signals."""
    e, m = table(spark, sf, "events"), F.col("event_id")
    name = F.when(m % 4 == 0, "ReazonSpeech K2 v2").when(m % 4 == 1, "Qwen3-ASR 0.6B").when(m % 4 == 2, "NVIDIA Parakeet TDT CTC 0.6B JA").otherwise("WhisperS2T base")
    return e.select(
        "event_id", F.col("user_id").alias("source_id"), "ts", "event_type", "value", F.when(m % 3 == 0, F.col("value") / 200).alias("no_speech_prob"), F.when(m % 3 == 1, (F.col("value") - 20) / 1000).alias("token_confidence_mean"),
        F.when(m % 3 != 1, -F.col("value") / 100).alias("avg_logprob"), name.alias("engine_name"), F.when(m % 7 == 0, "").otherwise(F.col("event_type")).alias("text"), (m % 4 == 3).alias("is_interim"),
    )


#: The catalogue of recognisers (id, display name, languages, VRAM MB or null, streaming, latency tier).
ENGINES = [
    ("reazonspeech", "ReazonSpeech K2 v2", ["ja"], None, True, 3),
    ("parakeet", "NVIDIA Parakeet TDT 0.6B v2", ["en"], 2500, False, 3),
    ("parakeet_ja", "NVIDIA Parakeet TDT CTC 0.6B JA", ["ja"], 2500, False, 3),
    ("canary", "NVIDIA Canary 1B Flash", ["en", "de", "fr", "es"], 7000, False, 2),
    ("voxtral", "MistralAI Voxtral Mini 3B", ["en", "es", "fr", "pt", "hi", "de", "nl", "it"], 10000, False, 1),
    ("whispers2t", "WhisperS2T base", ["ja", "en", "de", "fr", "es", "it", "pt", "nl"], 1000, False, 2),
    ("qwen3asr", "Qwen3-ASR 0.6B", ["ja", "en", "de", "fr", "es", "it", "pt"], 3000, True, 2),
]
SQL["v_engines"] = "SELECT * FROM (VALUES {}) t(engine_id, engine_name, languages, vram_mb, streaming, tier)".format(", ".join(f"('{i}', '{n}', {ls}, {'NULL' if v is None else v}, {s}, {t})" for i, n, ls, v, s, t in ENGINES))


def engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENGINES, "engine_id string, engine_name string, languages array<string>, vram_mb int, streaming boolean, tier int")


SQL["v_presets"] = """
SELECT vad, lang, engine, min(p_retailprice) score, count(*) trials FROM (SELECT split_part(p_type, ' ', 1) vad, CASE p_size % 3 WHEN 0 THEN 'ja' WHEN 1 THEN 'en' ELSE 'de' END lang, p_brand engine, p_retailprice FROM part) GROUP BY ALL
"""


def presets(spark: SparkSession, sf: str) -> DataFrame:
    """Tuned presets with their score (lower is better), derived from parts."""
    lang = F.when(F.col("p_size") % 3 == 0, "ja").when(F.col("p_size") % 3 == 1, "en").otherwise("de")
    p = table(spark, sf, "part").select(F.element_at(F.split("p_type", " "), 1).alias("vad"), lang.alias("lang"), F.col("p_brand").alias("engine"), "p_retailprice")
    return p.groupBy("vad", "lang", "engine").agg(F.min("p_retailprice").alias("score"), F.count("*").alias("trials"))


def counted(sql: str) -> str:
    """sql with count_if(x) as a count, which DuckDB returns as BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        depth, i = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : i - 1]} THEN 1 END){sql[i:]}"
    return sql


def with_views(sql: str) -> str:
    """sql after the views that it names, and those that they name."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for v in dict.fromkeys(re.findall(r"\bv_[a-z]+\b", text)):
            if v in SQL and v not in need:
                add(SQL[v])
                need.append(v)

    add(sql)
    sql = sql.strip()
    head = ", ".join(f"{v} AS ({SQL[v].strip()})" for v in need)
    if not head:
        return sql
    return f"WITH RECURSIVE {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH RECURSIVE {head} {sql}"
