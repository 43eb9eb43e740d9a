"""Thresholds from labelled signals: sweeps, breakdowns, recommendations, gates and guards.

``non_speech`` is the positive class; ``speech`` and ``noisy_speech`` are negative. A sample is rejected
when its signal is strictly below (``less``) or strictly above (``greater``) the threshold. Samples
without a signal take no part. Ratios with a zero denominator are 0.

A sweep never pairs samples with thresholds: every signal falls into one bucket of the sorted grid, the
buckets are counted with map-side combine, and running sums over the grid's few rows give all matrices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.runtime import few, materialise

#: Which side of a signal is rejected.
DIRECTIONS = {"avg_logprob": "less", "token_confidence_mean": "less", "no_speech_prob": "greater"}
CRITERIA = ("f1", "youden_j", "precision", "recall")


def grid(low: float, high: float, step: float) -> list[float]:
    """The inclusive grid, by index and rounded to ten places."""
    if step <= 0 or high < low:
        raise ValueError("a grid needs a positive step and high >= low")
    return [round(low + i * step, 10) for i in range(round((high - low) / step) + 1)]


def positive(label: str = "label") -> Column:
    return F.col(label) == "non_speech"


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(df: DataFrame) -> DataFrame:
    """df with columns tp, fp, tn, fn plus the rates of a confusion matrix."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    df = df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumns({"f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "youden_j": r + ratio(tn, tn + fp) - 1, "false_reject_rate": ratio(fp, fp + tn)})


def confusion_matrix(samples: DataFrame, threshold: float, direction: str = "less", signal: str = "signal", by: list[str] | None = None) -> DataFrame:
    s, pos = F.col(signal), positive()
    rejected = s < threshold if direction == "less" else s > threshold
    counts = [F.count_if(pos & rejected).alias("tp"), F.count_if(~pos & rejected).alias("fp"), F.count_if(~pos & ~rejected).alias("tn"), F.count_if(pos & ~rejected).alias("fn")]
    return rates(samples.filter(s.isNotNull()).groupBy(*(by or [])).agg(*counts)).withColumn("threshold", F.lit(float(threshold)))


def threshold_sweep(samples: DataFrame, thresholds: list[float], direction: str = "less", signal: str = "signal", by: list[str] | None = None, weight: Column | None = None, pos: Column | None = None) -> DataFrame:
    """One row per threshold (and group of ``by``): tp, fp, tn, fn and rates, in O(samples + thresholds)."""
    by = by or []
    ts = sorted(thresholds)
    pos = positive() if pos is None else pos
    s = F.col(signal)
    # less: thresholds from the first one above s on reject; greater: those below s reject
    above = F.lit(ts)
    below = (lambda x: F.size(F.filter(above, lambda t: t <= x))) if direction == "less" else (lambda x: F.size(F.filter(above, lambda t: t < x)))
    bucket = F.get(F.transform(F.array(s), below), F.lit(0))  # binds the signal once, not for every threshold
    n = F.count_if(F.lit(True))
    hist = samples.filter(s.isNotNull()).groupBy(*by, bucket.alias("bucket")).agg(F.count_if(pos).alias("p"), (n - F.count_if(pos)).alias("n"))
    # one array of running counts per group; the grid bounds its size
    bins = hist.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("p", "n")))).alias("m"), F.sum("p").alias("tot_p"), F.sum("n").alias("tot_n"))
    rows = bins.select(*by, "tot_p", "tot_n", "m", F.posexplode(above).alias("i", "threshold"))
    at = lambda b: F.try_element_at("m", b)
    rows = rows.select(*by, "tot_p", "tot_n", "i", "threshold", F.coalesce(at(F.col("i"))["p"], F.lit(0)).alias("p"), F.coalesce(at(F.col("i"))["n"], F.lit(0)).alias("n"))
    w = W.partitionBy(*by).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"below_p": F.sum("p").over(w), "below_n": F.sum("n").over(w)})
    if direction == "less":  # buckets 0..i hold the signals under the i-th threshold
        tp, fp = F.col("below_p"), F.col("below_n")
    else:
        tp, fp = F.col("tot_p") - F.col("below_p"), F.col("tot_n") - F.col("below_n")
    rows = rows.select(*by, "threshold", tp.alias("tp"), fp.alias("fp"), (F.col("tot_n") - fp).alias("tn"), (F.col("tot_p") - tp).alias("fn"))
    return rates(rows)


def recommended(sweep: DataFrame, criterion: str = "f1", direction: str = "less", by: list[str] | None = None) -> DataFrame:
    """The best row by the criterion; ties go to the threshold that rejects less."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    tie = -F.col("threshold") if direction == "less" else F.col("threshold")
    row = F.struct(*sweep.columns)
    return sweep.groupBy(*(by or [])).agg(F.max_by(row, F.struct(F.col(criterion), tie)).alias("r")).select("r.*")


def breakdown(samples: DataFrame, keys: list[str], thresholds: list[float], direction: str = "less", signal: str = "signal") -> DataFrame:
    """Sweeps per value of each key in one pass; a missing value is ``__none__``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("__none__")).alias("value")) for k in keys)))
    long = samples.select("label", signal, pairs.alias("kv")).select("label", signal, "kv.key", "kv.value")
    return threshold_sweep(long, thresholds, direction, signal, ["key", "value"])


def select_gate(sweep: DataFrame, frr: DataFrame, gates: DataFrame) -> DataFrame:
    """Of the strictest gate that any threshold passes, its threshold of the largest f1.

    frr: (threshold, population, false_reject_rate); gates: (gate, strictness, clean_max, noisy_max).
    """
    wide = frr.groupBy("threshold").agg(F.max(F.when(F.col("population") == "clean", F.col("false_reject_rate"))).alias("clean_frr"), F.max(F.when(F.col("population") != "clean", F.col("false_reject_rate"))).alias("noisy_frr"))
    ok = sweep.join(wide, "threshold").join(few(gates), (F.col("clean_frr") <= F.col("clean_max")) & (F.coalesce("noisy_frr", F.lit(0.0)) <= F.col("noisy_max")))
    best = ok.groupBy("gate", "strictness").agg(F.max_by(F.struct("threshold", "f1", "clean_frr", "noisy_frr"), F.struct(F.col("f1"), -F.col("threshold"))).alias("r"))
    return best.orderBy("strictness").limit(1).select("gate", "r.*")


GUARDS = ("baseline", "energy", "confidence", "both")


def guard_drops(energy: Column, empty: Column, confidence: Column) -> dict[str, Column]:
    """Whether each set of guards drops a row."""
    return {"baseline": empty, "energy": energy | empty, "confidence": empty | confidence, "both": energy | empty | confidence}


def guard_ablation(records: DataFrame) -> DataFrame:
    """records: label, error, energy_drop, empty_text, conf_reject. One row per guard set."""
    ok = records.filter(~F.col("error"))
    drops = guard_drops(F.col("energy_drop"), F.col("empty_text"), F.col("conf_reject"))
    long = ok.select(positive().alias("pos"), F.explode(F.array(*(F.struct(F.lit(k).alias("config"), v.alias("dropped")) for k, v in drops.items()))).alias("x")).select("pos", "x.*")
    pos, drop = F.col("pos"), F.col("dropped")
    out = long.groupBy("config").agg(F.count_if(pos & drop).alias("non_speech_suppressed"), F.count_if(pos).alias("non_speech_total"), F.count_if(~pos & drop).alias("speech_dropped"), F.count_if(~pos).alias("speech_total"))
    return out.withColumns({"suppression_rate": ratio(F.col("non_speech_suppressed"), F.col("non_speech_total")), "false_drop_rate": ratio(F.col("speech_dropped"), F.col("speech_total"))})


def guard_marginal(records: DataFrame) -> DataFrame:
    """What the energy guard alone catches and harms, in one row."""
    ok = records.filter(~F.col("error"))
    pos, e = positive(), F.col("energy_drop")
    others = F.col("empty_text") | F.col("conf_reject")
    return ok.agg(
        F.count_if(pos & e & ~others).alias("non_speech_energy_unique"), F.count_if(pos & e & others).alias("non_speech_energy_overlap"), F.count_if(pos & e).alias("non_speech_energy_total_drop"),
        F.count_if(~pos & e & ~others).alias("speech_energy_unique_harm"), F.count_if(~pos & e).alias("speech_energy_total_drop"), F.count_if(pos & e & ~F.col("empty_text")).alias("engine_nonempty"),
        F.count_if(pos & e & ~others).alias("engine_nonempty_conf_pass"),
    )


def top_examples(rows: DataFrame, by: list[str], order: list[str], fields: list[str], n: int) -> DataFrame:
    """The first n rows of each group as one array column ``examples``, ordered; never more rows are gathered."""
    first = rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= n)
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("examples"))


def with_examples(rows: DataFrame, totals: DataFrame, order: list[str], fields: list, n: int) -> DataFrame:
    """totals (one row) with ``examples``: the first n rows by order, fields joined by colons and rows by commas; null without rows."""
    first = rows.orderBy(*order).limit(n).select(F.struct(*order).alias("o"), F.concat_ws(":", *fields).alias("x"))
    shown = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda e: e["x"]).alias("xs"))
    shown = shown.select(F.when(F.size("xs") > 0, F.array_join("xs", ",")).alias("examples"), F.lit(1).alias("__one"))
    return totals.withColumn("__one", F.lit(1)).join(shown, "__one").drop("__one")


def percentiles(rows: DataFrame, by: list[str], value: str, qs: list[float], accuracy: int = 10_000) -> DataFrame:
    """(*by, q): the exact percentiles of the non-null values of every group, by linear interpolation, without gathering a group in one task.

    Sketches give two values around each percentile; a second pass counts what lies below them and, by value,
    what lies between, which is some ten-thousandths of a group. Groups without values have no row; without keys there is one group.
    """
    spread = 4 / accuracy
    v = F.col(value)
    x = materialise(rows.filter(v.isNotNull()).select(*by, v.cast("double").alias("v")), "values")
    probes = [min(1.0, max(0.0, q + d)) for q in qs for d in (-spread, spread)]
    sketch = x.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", probes, accuracy).alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    one = lambda i, q: F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), (F.get("b", F.lit(2 * i)) if q > spread else F.col("lo")).alias("from"), (F.get("b", F.lit(2 * i + 1)) if q < 1 - spread else F.col("hi")).alias("to"))
    bounds = sketch.select(*by, "n", F.explode(F.array(*(one(i, q) for i, q in enumerate(qs)))).alias("x")).select(*by, "n", "x.*").withColumn("__k", F.lit(1))
    # stored and counted: Spark takes an aggregate for as large as its input, and would deal all values by their few groups
    bounds = few(materialise(bounds, "bounds"))
    met = x.withColumn("__k", F.lit(1)).join(bounds, ["__k", *by])
    zone = F.when(F.col("v") < F.col("from"), -1).when(F.col("v") > F.col("to"), 1).otherwise(0)
    # below and above the bounds a group's rows are one count each, with the value next to the bound; between them one for every value
    counts = met.groupBy(*by, "i", "q", "n", zone.alias("zone"), F.when(zone == 0, F.col("v")).alias("at")).agg(F.count("*").alias("c"), F.when(zone < 0, F.max("v")).otherwise(F.min("v")).alias("v"))
    cum = F.sum("c").over(W.partitionBy(*by, "i").orderBy("zone", "v"))
    rank = F.col("q") * (F.col("n") - 1)
    low = F.floor(rank)
    ranked = counts.withColumn("cum", cum)
    pair = ranked.groupBy(*by, "i").agg(F.min(F.when(F.col("cum") > low, F.col("v"))).alias("a"), F.min(F.when(F.col("cum") > low + 1, F.col("v"))).alias("b"), F.first(rank - low).alias("f"))
    found = pair.select(*by, "i", F.when(F.col("f") > 0, F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).otherwise(F.col("a")).alias("x"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("q"))


def signal_distribution(samples: DataFrame, signal: str = "signal") -> DataFrame:
    s = F.col(signal)
    ok = samples.filter(~F.col("error") & s.isNotNull()).select(F.when(positive(), "non_speech").otherwise("speech").alias("label"), s.alias("s"))
    g = ok.groupBy("label").agg(F.count("*").alias("n"), F.min("s").alias("min"), F.max("s").alias("max")).join(percentiles(ok, ["label"], "s", [0.05, 0.5, 0.95]), "label")
    return g.select("label", "n", "min", F.col("q")[0].alias("p5"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "max")


def signal_coverage(samples: DataFrame, floor: float = 0.95, signal: str = "signal") -> DataFrame:
    g = samples.filter(~F.col("error")).groupBy(F.when(positive(), "non_speech").otherwise("speech").alias("label"))
    g = g.agg(F.count("*").alias("success"), F.count(signal).alias("signal_non_null"))
    rate = F.col("signal_non_null") / F.col("success")
    return g.select("label", "success", "signal_non_null", (F.col("success") - F.col("signal_non_null")).alias("signal_missing"), rate.alias("coverage_rate"), (rate < floor).alias("warning"))


def filter_confusion(measured: DataFrame) -> DataFrame:
    """measured: label, error, rejected, text. Speech: rejected and their rate; non-speech: leaks (kept non-empty texts) and their rate."""
    ok = measured.filter(~F.col("error")).withColumn("full", F.trim("text") != "")
    pos = positive()
    g = ok.groupBy(F.when(pos, "non_speech").otherwise("speech").alias("label")).agg(F.count("*").alias("n"), F.count_if("rejected").alias("rejected"), F.count_if(pos & F.col("full")).alias("non_empty_text"), F.count_if(pos & F.col("full") & ~F.col("rejected")).alias("leak"))
    speech = F.col("label") == "speech"
    return g.select("label", "n", "rejected", F.when(~speech, F.col("non_empty_text")).alias("non_empty_text"), F.when(~speech, F.col("leak")).alias("leak"), F.when(speech, F.col("rejected") / F.col("n")).otherwise(F.col("leak") / F.col("n")).alias("rate"))
