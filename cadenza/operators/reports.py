"""Reports over run results and sweep cells: means, percentiles, deltas, Pareto and promotion verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.calibration import percentiles
from cadenza.runtime import few


def means_by(results: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Means over non-null metrics, the largest GPU peak, files and total duration (0 if none)."""
    return results.groupBy(*keys).agg(F.avg("wer").alias("wer"), F.avg("cer").alias("cer"), F.avg("rtf").alias("rtf"), F.max("gpu_mb").alias("gpu_peak_mb"), F.count("*").alias("files"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"))


def best_by_language(means: DataFrame) -> DataFrame:
    """Per language the engine of the least mean CER for ja, WER otherwise; groups without the metric lose, ties by name."""
    metric = F.when(F.col("language") == "ja", F.col("cer")).otherwise(F.col("wer"))
    m = means.withColumn("metric", metric).filter("metric is not null")
    return m.groupBy("language").agg(F.min_by(F.struct("engine", "metric"), F.struct("metric", "engine")).alias("r")).select("language", "r.engine", "r.metric")


def extremes(means: DataFrame) -> DataFrame:
    """The fastest (least mean RTF) and leanest (least GPU peak) engine and language, in one row."""
    return means.agg(F.min_by(F.struct("engine", "language", "rtf"), F.struct("rtf", "engine", "language")).alias("f"), F.min_by(F.struct("engine", "language", "gpu_peak_mb"), F.struct("gpu_peak_mb", "engine", "language")).alias("l")).select(
        F.col("f.engine").alias("fastest_engine"), F.col("f.language").alias("fastest_language"), F.col("f.rtf").alias("rtf"), F.col("l.engine").alias("leanest_engine"), F.col("l.language").alias("leanest_language"), F.col("l.gpu_peak_mb").alias("gpu_peak_mb")
    )


def latency_summary(measured: DataFrame, latency: str = "latency", rtf: str = "rtf") -> DataFrame:
    """Mean, percentiles (linear interpolation) and maximum of latency, and of RTF where there is a duration, in one row."""
    m = measured.filter(~F.col("error")).select(F.col(latency).alias("x"), F.when(F.col("duration") > 0, F.col(rtf)).alias("r"))
    g = m.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("max"), F.avg("r").alias("rtf_mean"), F.max("r").alias("rtf_max"), F.lit(1).alias("k"))
    both = m.select(F.explode(F.array(F.struct(F.lit("x").alias("of"), F.col("x").alias("v")), F.struct(F.lit("r").alias("of"), F.col("r").alias("v")))).alias("e")).select("e.*")
    q = percentiles(both, ["of"], "v", [0.5, 0.9, 0.95]).groupBy(F.lit(1).alias("k")).agg(*(F.max(F.when(F.col("of") == of, F.col("q"))).alias(name) for of, name in (("x", "q"), ("r", "rq"))))
    g = g.join(q, "k", "left")
    return g.select("n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p95"), "max", "rtf_mean", F.col("rq")[0].alias("rtf_p50"), F.col("rq")[2].alias("rtf_p95"), "rtf_max")


KEYS = ["backend", "engine", "corpus"]


def with_baseline(cells: DataFrame, fields: list[str], baseline: str = "baseline_off") -> DataFrame:
    """Every other cell with its baseline's fields (prefix base_); cells without one are left out."""
    base = cells.filter(F.col("preset") == baseline).select(*KEYS, *(F.col(f).alias(f"base_{f}") for f in fields))
    return cells.filter(F.col("preset") != baseline).join(base, KEYS)


def deltas(cells: DataFrame) -> DataFrame:
    return with_baseline(cells, ["hallucination"]).withColumn("delta", F.col("hallucination") - F.col("base_hallucination"))


def best_presets(cells: DataFrame) -> DataFrame:
    """Per backend, engine and corpus the preset of the least hallucination rate."""
    return cells.filter("hallucination is not null").groupBy(*KEYS).agg(F.min_by("preset", F.struct("hallucination", "preset")).alias("best_preset"))


def regressions(cells: DataFrame, slack: float = 1e-9) -> DataFrame:
    """(preset, keys, metric, value, base) where a recall is below its baseline."""
    j = with_baseline(cells, ["recall", "short_recall"])
    long = j.select("preset", *KEYS, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"base_{m}").alias("base")) for m in ("recall", "short_recall")))).alias("x")).select("preset", *KEYS, "x.*")
    return long.filter(F.col("value") < F.col("base") - slack)


def pareto(cells: DataFrame) -> DataFrame:
    """Per preset means, at six places, and whether no other is strictly lower in false triggers with recalls no worse; a null recall compares as no worse."""
    # means of whole millionths, whose sums are exact: presets that tie do so in any order of rows
    mean = lambda c: (F.floor(F.avg(F.floor(F.col(c) * 1e6 + 0.5)) + 0.5) / 1e6).alias(c)
    m = cells.groupBy("preset").agg(mean("false_trigger"), mean("recall"), mean("short_recall"))
    a, b = m.alias("a"), few(m.alias("b"), 10_000)  # one row a preset
    worse = lambda c: F.col(f"b.{c}") < F.col(f"a.{c}")
    beats = (F.col("b.preset") != F.col("a.preset")) & (F.col("b.false_trigger") < F.col("a.false_trigger")) & ~F.coalesce(worse("recall"), F.lit(False)) & ~F.coalesce(worse("short_recall"), F.lit(False))
    free = a.join(b, beats, "left_anti").filter("false_trigger is not null").select("preset", F.lit(True).alias("free"))
    return m.join(free, "preset", "left").select("preset", "false_trigger", "recall", "short_recall", F.coalesce("free", F.lit(False)).alias("dominant"))


def floor_violations(cells: DataFrame, exempt: DataFrame, recall: float = 0.95, short_recall: float = 1.0) -> DataFrame:
    """Recalls below absolute floors, but for exempt (backend, corpus) pairs."""
    c = cells.join(few(exempt), ["backend", "corpus"], "left_anti")
    floors = {"recall": recall, "short_recall": short_recall}
    long = c.select("preset", *KEYS, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(f)).alias("floor")) for m, f in floors.items()))).alias("x")).select("preset", *KEYS, "x.*")
    return long.filter(F.col("value") < F.col("floor"))


def promotion(cells: DataFrame, target: dict[str, str], exempt: DataFrame, drop: float = 0.3, recall: float = 0.95, short_recall: float = 1.0) -> DataFrame:
    """One row: status and winner. Candidates fall by ``drop`` on the target cell; winners also regress nowhere and break no floor."""
    d = deltas(cells)
    for k, v in target.items():
        d = d.filter(F.col(k) == v)
    met = d.filter((F.col("base_hallucination") > 0) & (F.col("delta") / F.col("base_hallucination") <= -drop)).select("preset", "hallucination")
    bad = regressions(cells).select("preset").union(floor_violations(cells, exempt, recall, short_recall).select("preset")).distinct().withColumn("bad", F.lit(True))
    judged = met.join(bad, "preset", "left").withColumn("safe", F.col("bad").isNull())
    best = judged.agg(F.min_by(F.when(F.col("safe"), F.col("preset")), F.when(F.col("safe"), F.struct("hallucination", "preset"))).alias("winner"), F.count("*").alias("candidates"))
    status = F.when(F.col("winner").isNotNull(), "promote").when(F.col("candidates") > 0, "no-safe-winner").otherwise("target-not-met")
    return best.select(status.alias("status"), "winner", "candidates")
