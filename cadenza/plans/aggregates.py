"""Queries of thresholds, guards and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T  # noqa: F401

from cadenza.operators import calibration as C
from cadenza.operators import reports as R
from cadenza.plans import suite as S
from cadenza.plans.suite import query, r6, round_doubles

GRID = C.grid(0.05, 0.95, 0.01)

S.SQL["v_guard"] = "SELECT doc_id, label, error, n_chars % 10 < 2 energy_drop, doc_id % 13 = 0 empty_text, coalesce(signal < 0.5, false) conf_reject, signal, text, lang, snr FROM v_samples"


def guards(spark, sf):
    d = S.samples(spark, sf)
    return d.select("doc_id", "label", "error", (F.col("n_chars") % 10 < 2).alias("energy_drop"), (F.col("doc_id") % 13 == 0).alias("empty_text"), F.coalesce(F.col("signal") < 0.5, F.lit(False)).alias("conf_reject"), "signal", "text", "lang", "snr")


RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END recall,
 CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END false_reject_rate, CASE WHEN fp + tn > 0 THEN tn / (fp + tn) ELSE 0 END spec"""
METRICS = """round("precision", 6) "precision", round(recall, 6) recall, round(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END, 6) f1,
 round(recall + spec - 1, 6) + 0.0 youden_j, round(false_reject_rate, 6) false_reject_rate"""
COUNTS = "count_if(pos AND rej) tp, count_if(NOT pos AND rej) fp, count_if(NOT pos AND NOT rej) tn, count_if(pos AND NOT rej) fn"
S.SQL["v_grid"] = "SELECT round(0.05::DOUBLE + i * 0.01::DOUBLE, 10) threshold FROM (SELECT unnest(generate_series(0, 90)) i)"
S.SQL["v_sweep"] = f"SELECT threshold, tp, fp, tn, fn, {RATES} FROM (SELECT threshold, {COUNTS} FROM (SELECT threshold, label = 'non_speech' pos, signal < threshold rej FROM v_samples, v_grid WHERE signal IS NOT NULL) GROUP BY threshold)"


@query("confusion_matrix", f"SELECT 0.5::DOUBLE threshold, tp, fp, tn, fn, {METRICS} FROM (SELECT *, {RATES} FROM (SELECT {COUNTS} FROM (SELECT label = 'non_speech' pos, signal < 0.5 rej FROM v_samples WHERE signal IS NOT NULL)))")
def confusion_matrix(spark, sf):
    return round_doubles(C.confusion_matrix(S.samples(spark, sf), 0.5))


@query("threshold_sweep", f"SELECT threshold, tp, fp, tn, fn, {METRICS} FROM v_sweep")
def threshold_sweep(spark, sf):
    return round_doubles(C.threshold_sweep(S.samples(spark, sf), GRID))


@query("recommended_threshold", f"SELECT threshold, tp, fp, tn, fn, {METRICS} FROM v_sweep ORDER BY CASE WHEN \"precision\" + recall > 0 THEN 2 * \"precision\" * recall / (\"precision\" + recall) ELSE 0 END DESC, threshold LIMIT 1")
def recommended_threshold(spark, sf):
    return round_doubles(C.recommended(C.threshold_sweep(S.samples(spark, sf), GRID)))


@query("sweep_breakdown", f"""
WITH long AS (SELECT label, signal, 'lang' AS key, coalesce(lang, '__none__') AS value FROM v_samples UNION ALL SELECT label, signal, 'source', coalesce(source, '__none__') FROM v_samples UNION ALL SELECT label, signal, 'snr', coalesce(CAST(snr AS VARCHAR), '__none__') FROM v_samples),
c AS (SELECT key, value, threshold, {COUNTS} FROM (SELECT *, label = 'non_speech' pos, signal < threshold rej FROM long, v_grid WHERE signal IS NOT NULL) GROUP BY key, value, threshold)
SELECT key, value, threshold, tp, fp, tn, fn, {METRICS} FROM (SELECT *, {RATES} FROM c)""")
def sweep_breakdown(spark, sf):
    return round_doubles(C.breakdown(S.samples(spark, sf), ["lang", "source", "snr"], GRID))


#: The gates, strictest first (clean and noisy false reject rates allowed).
GATES = [("strict", 1, 0.01, 0.02), ("relaxed_A", 2, 0.02, 0.05), ("relaxed_B", 3, 0.03, 0.10), ("relaxed_C", 4, 0.05, 0.20)]


@query("gate_selection", """
WITH gates(gate, strictness, clean_max, noisy_max) AS (VALUES ('strict', 1, 0.01, 0.02), ('relaxed_A', 2, 0.02, 0.05), ('relaxed_B', 3, 0.03, 0.10), ('relaxed_C', 4, 0.05, 0.20)),
pop AS (SELECT threshold, CASE WHEN snr IS NULL THEN 'clean' ELSE 'snr' || snr END p, count_if(signal < threshold) / count(*) frr FROM v_samples, v_grid WHERE signal IS NOT NULL AND label <> 'non_speech' GROUP BY ALL),
wide AS (SELECT threshold, max(frr) FILTER (p = 'clean') clean_frr, max(frr) FILTER (p <> 'clean') noisy_frr FROM pop GROUP BY threshold),
f AS (SELECT threshold, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END f1 FROM v_sweep)
SELECT gate, threshold, round(f1, 6) f1, round(clean_frr, 6) clean_frr, round(noisy_frr, 6) noisy_frr FROM f JOIN wide USING (threshold), gates
WHERE clean_frr <= clean_max AND coalesce(noisy_frr, 0) <= noisy_max ORDER BY strictness, f1 DESC, threshold LIMIT 1""")
def gate_selection(spark, sf):
    s = S.samples(spark, sf)
    population = F.when(F.col("snr").isNull(), "clean").otherwise(F.concat(F.lit("snr"), F.col("snr").cast("string")))
    speech = s.filter(~C.positive()).withColumn("population", population)
    frr = C.threshold_sweep(speech, GRID, by=["population"]).select("threshold", "population", "false_reject_rate")
    gates = spark.createDataFrame(GATES, "gate string, strictness int, clean_max double, noisy_max double")
    return round_doubles(C.select_gate(C.threshold_sweep(s, GRID), frr, gates))


@query("join_threshold_grid", "SELECT threshold, count(*) n, count_if(signal < threshold) rejected FROM v_samples, v_grid WHERE signal IS NOT NULL GROUP BY threshold")
def join_threshold_grid(spark, sf):
    """Every sample meets every threshold of the parameter grid; the rows are made and reduced within a task."""
    s = S.samples(spark, sf).filter("signal is not null")
    return s.select("signal", F.explode(F.lit(GRID)).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col("signal") < F.col("threshold")).alias("rejected"))


@query("guard_combinations", """
WITH x AS (SELECT doc_id, unnest(['baseline', 'energy', 'confidence', 'both']) config, unnest([empty_text, energy_drop OR empty_text, empty_text OR conf_reject, energy_drop OR empty_text OR conf_reject]) dropped FROM v_guard) SELECT * FROM x""")
def guard_combinations(spark, sf):
    d = C.guard_drops(F.col("energy_drop"), F.col("empty_text"), F.col("conf_reject"))
    return guards(spark, sf).select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("config"), v.alias("dropped")) for k, v in d.items()))).alias("x")).select("doc_id", "x.*")


@query("guard_ablation", """
WITH x AS (SELECT label = 'non_speech' pos, unnest(['baseline', 'energy', 'confidence', 'both']) config, unnest([empty_text, energy_drop OR empty_text, empty_text OR conf_reject, energy_drop OR empty_text OR conf_reject]) d FROM v_guard WHERE NOT error),
c AS (SELECT config, count_if(pos AND d) non_speech_suppressed, count_if(pos) non_speech_total, count_if(NOT pos AND d) speech_dropped, count_if(NOT pos) speech_total FROM x GROUP BY config)
SELECT *, round(CASE WHEN non_speech_total > 0 THEN non_speech_suppressed / non_speech_total ELSE 0 END, 6) suppression_rate, round(CASE WHEN speech_total > 0 THEN speech_dropped / speech_total ELSE 0 END, 6) false_drop_rate FROM c""")
def guard_ablation(spark, sf):
    return round_doubles(C.guard_ablation(guards(spark, sf)))


@query("guard_marginal", """
SELECT count_if(pos AND energy_drop AND NOT o) non_speech_energy_unique, count_if(pos AND energy_drop AND o) non_speech_energy_overlap, count_if(pos AND energy_drop) non_speech_energy_total_drop, count_if(NOT pos AND energy_drop AND NOT o) speech_energy_unique_harm,
count_if(NOT pos AND energy_drop) speech_energy_total_drop, count_if(pos AND energy_drop AND NOT empty_text) engine_nonempty, count_if(pos AND energy_drop AND NOT o) engine_nonempty_conf_pass, (SELECT string_agg(doc_id || '', ',' ORDER BY doc_id) FROM (SELECT doc_id FROM v_guard WHERE NOT error AND label = 'non_speech' AND energy_drop AND NOT (empty_text OR conf_reject) ORDER BY doc_id LIMIT 10)) examples FROM (SELECT *, label = 'non_speech' pos, empty_text OR conf_reject o FROM v_guard WHERE NOT error)""")
def guard_marginal(spark, sf):
    """Counts, and the first ten silent inputs whose output is not empty and passes."""
    g = guards(spark, sf)
    passed = g.filter(~F.col("error") & (F.col("label") == "non_speech") & F.col("energy_drop") & ~F.col("empty_text") & ~F.col("conf_reject"))
    return C.with_examples(passed, C.guard_marginal(g), ["doc_id"], [F.col("doc_id").cast("string")], 10)


@query("signal_distribution", """
SELECT CASE WHEN label = 'non_speech' THEN label ELSE 'speech' END AS label, count(*) n, round(min(signal), 6) min, round(quantile_cont(signal, 0.05), 6) p5, round(quantile_cont(signal, 0.5), 6) p50, round(quantile_cont(signal, 0.95), 6) p95, round(max(signal), 6) max
FROM v_samples WHERE NOT error AND signal IS NOT NULL GROUP BY 1""")
def signal_distribution(spark, sf):
    return round_doubles(C.signal_distribution(S.samples(spark, sf)))


@query("signal_coverage", """
SELECT CASE WHEN label = 'non_speech' THEN label ELSE 'speech' END AS label, count(*) success, count(signal) signal_non_null, count(*) - count(signal) signal_missing, round(count(signal) / count(*), 6) coverage_rate, count(signal) / count(*) < 0.95 warning FROM v_samples WHERE NOT error GROUP BY 1""")
def signal_coverage(spark, sf):
    return round_doubles(C.signal_coverage(S.samples(spark, sf)))


@query("filter_confusion", """
WITH g AS (SELECT CASE WHEN label = 'non_speech' THEN label ELSE 'speech' END AS label, CASE WHEN empty_text THEN '' ELSE text END t, conf_reject FROM v_guard WHERE NOT error)
SELECT label, count(*) n, count_if(conf_reject) rejected, CASE WHEN label <> 'speech' THEN count_if(trim(t) <> '') END non_empty_text, CASE WHEN label <> 'speech' THEN count_if(trim(t) <> '' AND NOT conf_reject) END leak,
round(CASE WHEN label = 'speech' THEN count_if(conf_reject) / count(*) ELSE count_if(trim(t) <> '' AND NOT conf_reject) / count(*) END, 6) rate, CASE WHEN label <> 'speech' THEN (SELECT string_agg(doc_id || '', ',' ORDER BY doc_id) FROM (SELECT doc_id FROM v_guard WHERE NOT error AND label = 'non_speech' AND NOT empty_text AND trim(text) <> '' AND NOT conf_reject ORDER BY doc_id LIMIT 10)) END examples FROM g GROUP BY label""")
def filter_confusion(spark, sf):
    """Rates by label, and the first ten leaks."""
    g = guards(spark, sf).withColumn("text", F.when(F.col("empty_text"), "").otherwise(F.col("text"))).withColumn("rejected", F.col("conf_reject"))
    leaks = g.filter(~F.col("error") & (F.col("label") == "non_speech") & ~F.col("rejected") & (F.trim("text") != ""))
    out = C.with_examples(leaks, round_doubles(C.filter_confusion(g)), ["doc_id"], [F.col("doc_id").cast("string")], 10)
    return out.withColumn("examples", F.when(F.col("label") != "speech", F.col("examples")))


@query("top_examples", """
SELECT label, list(doc_id ORDER BY doc_id) examples FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) r FROM v_guard WHERE NOT error AND NOT conf_reject AND NOT empty_text) WHERE r <= 10 GROUP BY label""")
def top_examples(spark, sf):
    g = guards(spark, sf).filter(~F.col("error") & ~F.col("conf_reject") & ~F.col("empty_text"))
    return C.top_examples(g, ["label"], ["doc_id"], ["doc_id"], 10).select("label", F.col("examples.doc_id").alias("examples"))


@query("corpus_label_counts", "SELECT label, lang, count(*) n, count(*) - count(signal) excluded FROM v_samples GROUP BY CUBE (label, lang)")
def corpus_label_counts(spark, sf):
    return S.samples(spark, sf).cube("label", "lang").agg(F.count("*").alias("n"), (F.count("*") - F.count("signal")).alias("excluded"))


MEANS = "round(avg(wer), 6) wer, round(avg(cer), 6) cer, round(avg(rtf), 6) rtf, round(max(gpu_mb), 6) gpu_peak_mb, count(*) files, round(coalesce(sum(duration), 0), 6) total_duration"


@query("benchmark_by_engine", f"SELECT engine, language, {MEANS} FROM v_results GROUP BY engine, language")
def benchmark_by_engine(spark, sf):
    return round_doubles(R.means_by(S.results(spark, sf), ["engine", "language"]))


@query("benchmark_by_engine_vad", f"SELECT engine, coalesce(vad, 'unknown') vad, language, {MEANS} FROM v_results GROUP BY ALL")
def benchmark_by_engine_vad(spark, sf):
    return round_doubles(R.means_by(S.results(spark, sf), ["engine", F.coalesce("vad", F.lit("unknown")).alias("vad"), "language"]))


@query("best_by_language", """
WITH m AS (SELECT engine, language, CASE WHEN language = 'ja' THEN avg(cer) ELSE avg(wer) END metric FROM v_results GROUP BY engine, language)
SELECT language, arg_min(engine, (metric, engine)) engine, round(min(metric), 6) metric FROM m WHERE metric IS NOT NULL GROUP BY language""")
def best_by_language(spark, sf):
    return round_doubles(R.best_by_language(R.means_by(S.results(spark, sf), ["engine", "language"])))


@query("fastest_and_leanest", """
WITH m AS (SELECT engine, language, avg(rtf) rtf, max(gpu_mb) g FROM v_results GROUP BY engine, language)
SELECT f.engine fastest_engine, f.language fastest_language, round(f.rtf, 6) rtf, l.engine leanest_engine, l.language leanest_language, round(l.g, 6) gpu_peak_mb
FROM (SELECT * FROM m ORDER BY rtf, engine, language LIMIT 1) f, (SELECT * FROM m ORDER BY g, engine, language LIMIT 1) l""")
def fastest_and_leanest(spark, sf):
    return round_doubles(R.extremes(R.means_by(S.results(spark, sf), ["engine", "language"])))


@query("benchmark_totals", "SELECT engine, language, count(*) files, round(sum(duration), 6) duration FROM v_results GROUP BY ROLLUP (engine, language)")
def benchmark_totals(spark, sf):
    return round_doubles(S.results(spark, sf).rollup("engine", "language").agg(F.count("*").alias("files"), F.sum("duration").alias("duration")))


@query("run_mean_rtf", "SELECT file_id, round(avg(proc_time), 9) mean_time, round(CASE WHEN max(duration) > 0 THEN avg(proc_time) / max(duration) ELSE 0 END, 6) rtf FROM v_results GROUP BY file_id")
def run_mean_rtf(spark, sf):
    g = S.results(spark, sf).groupBy("file_id").agg(F.avg("proc_time").alias("mean_time"), F.max("duration").alias("d"))
    return g.select("file_id", F.round("mean_time", 9).alias("mean_time"), r6(C.ratio(F.col("mean_time"), F.col("d")), "rtf"))


@query("latency_summary", """
SELECT count(*) n, round(avg(proc_time), 6) mean, round(quantile_cont(proc_time, 0.5), 6) p50, round(quantile_cont(proc_time, 0.9), 6) p90, round(quantile_cont(proc_time, 0.95), 6) p95, round(max(proc_time), 6) max,
round(avg(r), 6) rtf_mean, round(quantile_cont(r, 0.5), 6) rtf_p50, round(quantile_cont(r, 0.95), 6) rtf_p95, round(max(r), 6) rtf_max FROM (SELECT *, CASE WHEN duration > 0 THEN rtf END r FROM v_results WHERE result_id % 29 <> 0)""")
def latency_summary(spark, sf):
    m = S.results(spark, sf).withColumn("error", F.col("result_id") % 29 == 0).withColumnRenamed("proc_time", "latency")
    return round_doubles(R.latency_summary(m))


@query("run_stats", "SELECT count(*) total, count_if(event_type <> 'error') success, count_if(event_type = 'error') errors, round(count_if(event_type = 'error') / nullif(count(*), 0), 6) error_rate FROM events")
def run_stats(spark, sf):
    e = F.col("event_type") == "error"
    return round_doubles(S.table(spark, sf, "events").agg(F.count("*").alias("total"), F.count_if(~e).alias("success"), F.count_if(e).alias("errors"), F.try_divide(F.count_if(e), F.count("*")).alias("error_rate")))


@query("pipeline_rates", """
WITH seg AS (SELECT doc_id, unnest(range(doc_id % 4)) s FROM v_samples), i AS (SELECT v.doc_id, label = 'non_speech' neg, v.n_chars < 800 short, v.n_chars / 1000 latency, count(s) FILTER (v.doc_id % 5 <> 0) texts, count(s) segs, count(s) FILTER (v.doc_id % 5 <> 0 AND coalesce(signal >= 0.5, true)) kept FROM v_samples v LEFT JOIN seg USING (doc_id) GROUP BY ALL)
SELECT neg_run AS run, round(count_if(neg AND segs > 0) / nullif(count_if(neg), 0), 6) false_trigger_rate, round(count_if(NOT neg AND segs > 0) / nullif(count_if(NOT neg), 0), 6) recall, round(count_if(NOT neg AND short AND segs > 0) / nullif(count_if(NOT neg AND short), 0), 6) short_recall,
round(count_if(neg AND texts > 0) / nullif(count_if(neg), 0), 6) hallucination_pre, round(count_if(neg AND kept > 0) / nullif(count_if(neg), 0), 6) hallucination_post, round(count_if(NOT neg AND kept > 0) / nullif(count_if(NOT neg), 0), 6) recall_post,
round(count_if(NOT neg AND short AND kept > 0) / nullif(count_if(NOT neg AND short), 0), 6) short_recall_post, round(quantile_cont(latency, 0.5), 6) latency_p50, round(quantile_cont(latency, 0.95), 6) latency_p95
FROM (SELECT *, doc_id % 3 neg_run FROM i) GROUP BY neg_run""")
def pipeline_rates(spark, sf):
    """Items with their segments (0 to 3 each), of which a filter keeps those of a confident item."""
    s = S.samples(spark, sf).withColumn("seg", F.explode_outer(F.when(F.col("doc_id") % 4 > 0, F.sequence(F.lit(1), F.col("doc_id") % 4))))
    text = F.col("seg").isNotNull() & (F.col("doc_id") % 5 != 0)  # every fifth item's segments give no text
    keep = F.coalesce(F.col("signal") >= 0.5, F.lit(True)) & text
    items = s.groupBy("doc_id").agg(F.first(C.positive()).alias("neg"), F.first(F.col("n_chars") < 800).alias("short"), F.first(F.col("n_chars") / 1000).alias("latency"), F.count("seg").alias("segs"), F.count_if(text).alias("texts"), F.count_if(keep).alias("kept"))
    rate = lambda hit, of: F.try_divide(F.count_if(hit & of), F.count_if(of))
    neg, short, seg, texts, kept = F.col("neg"), F.col("short"), F.col("segs") > 0, F.col("texts") > 0, F.col("kept") > 0
    rates = {"false_trigger_rate": rate(seg, neg), "recall": rate(seg, ~neg), "short_recall": rate(seg, ~neg & short), "hallucination_pre": rate(texts, neg), "hallucination_post": rate(kept, neg), "recall_post": rate(kept, ~neg), "short_recall_post": rate(kept, ~neg & short)}
    items = items.withColumn("run", F.col("doc_id") % 3)
    g = items.groupBy("run").agg(*(c.alias(n) for n, c in rates.items())).join(C.percentiles(items, ["run"], "latency", [0.5, 0.95]), "run")
    return round_doubles(g.select("run", *rates, F.col("q")[0].alias("latency_p50"), F.col("q")[1].alias("latency_p95")))


CELL = "preset, backend, engine, corpus"
S.SQL["v_based"] = """SELECT c.*, b.hallucination base_hallucination, b.recall base_recall, b.short_recall base_short FROM v_cells c JOIN v_cells b USING (backend, engine, corpus) WHERE b.preset = 'baseline_off' AND c.preset <> 'baseline_off'"""


@query("join_baseline", f"SELECT {CELL}, hallucination, base_hallucination, recall, base_recall FROM v_based")
def join_baseline(spark, sf):
    return R.with_baseline(S.cells(spark, sf), ["hallucination", "recall"]).select("preset", *R.KEYS, "hallucination", "base_hallucination", "recall", "base_recall")


@query("preset_deltas", f"""SELECT {CELL}, round(hallucination - base_hallucination, 6) + 0.0 AS delta, best_preset FROM v_based JOIN (SELECT backend, engine, corpus, arg_min(preset, (hallucination, preset)) best_preset FROM v_cells WHERE hallucination IS NOT NULL GROUP BY ALL) USING (backend, engine, corpus)""")
def preset_deltas(spark, sf):
    c = S.cells(spark, sf)
    return round_doubles(R.deltas(c).join(R.best_presets(c), R.KEYS).select("preset", *R.KEYS, "delta", "best_preset"))


S.SQL["v_regress"] = f"SELECT {CELL}, 'recall' metric, recall AS value, base_recall base FROM v_based WHERE recall < base_recall - 1e-9 UNION ALL SELECT {CELL}, 'short_recall', short_recall, base_short FROM v_based WHERE short_recall < base_short - 1e-9"


@query("recall_regressions", "SELECT * FROM v_regress")
def recall_regressions(spark, sf):
    return R.regressions(S.cells(spark, sf))


@query("preset_pareto", """
WITH m AS (SELECT preset, floor(avg(floor(false_trigger * 1e6 + 0.5)::BIGINT) + 0.5) / 1e6 f, floor(avg(floor(recall * 1e6 + 0.5)::BIGINT) + 0.5) / 1e6 r, floor(avg(floor(short_recall * 1e6 + 0.5)::BIGINT) + 0.5) / 1e6 s FROM v_cells GROUP BY preset)
SELECT preset, f false_trigger, r recall, s short_recall, f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m b WHERE b.preset <> m.preset AND b.f < m.f AND NOT coalesce(b.r < m.r, false) AND NOT coalesce(b.s < m.s, false)) dominant FROM m""")
def preset_pareto(spark, sf):
    return R.pareto(S.cells(spark, sf))


FLOORS = (0.96, 0.955)
S.SQL["v_floor"] = f"SELECT {CELL}, 'recall' metric, recall AS value, {FLOORS[0]}::DOUBLE AS floor FROM v_cells WHERE recall < {FLOORS[0]} AND NOT (backend = 'O' AND corpus = 'A') UNION ALL SELECT {CELL}, 'short_recall', short_recall, {FLOORS[1]}::DOUBLE FROM v_cells WHERE short_recall < {FLOORS[1]} AND NOT (backend = 'O' AND corpus = 'A')"


def exempt(spark):
    return spark.createDataFrame([("O", "A")], "backend string, corpus string")


@query("floor_violations", "SELECT * FROM v_floor")
def floor_violations(spark, sf):
    return R.floor_violations(S.cells(spark, sf), exempt(spark), *FLOORS)


@query("promotion_verdict", """
WITH met AS (SELECT preset, hallucination FROM v_based WHERE backend = 'F' AND engine = 'e1' AND corpus = 'A' AND base_hallucination > 0 AND (hallucination - base_hallucination) / base_hallucination <= -0.01),
safe AS (SELECT * FROM met WHERE preset NOT IN (SELECT preset FROM v_regress) AND preset NOT IN (SELECT preset FROM v_floor))
SELECT CASE WHEN (SELECT count(*) FROM safe) > 0 THEN 'promote' WHEN (SELECT count(*) FROM met) > 0 THEN 'no-safe-winner' ELSE 'target-not-met' END status, (SELECT arg_min(preset, (hallucination, preset)) FROM safe) winner, (SELECT count(*) FROM met) candidates""")
def promotion_verdict(spark, sf):
    return R.promotion(S.cells(spark, sf), {"backend": "F", "engine": "e1", "corpus": "A"}, exempt(spark), 0.01, *FLOORS)


@query("drop_counts", """
WITH e AS (SELECT user_id, CASE WHEN event_type IN ('error', 'click') THEN event_type END reason, value FROM events)
SELECT user_id, count(*) detected, count(*) - count(reason) emitted, count_if(reason IS DISTINCT FROM 'click') asr_calls, count_if(reason = 'error') asr_errors, string_agg(DISTINCT reason, ',' ORDER BY reason) reasons FROM e GROUP BY user_id""")
def drop_counts(spark, sf):
    e = S.table(spark, sf, "events").withColumn("reason", F.when(F.col("event_type").isin("error", "click"), F.col("event_type")))
    return outcome_counts(e, "user_id").select("user_id", "detected", "emitted", "asr_calls", "asr_errors", F.nullif(F.array_join(F.array_sort(F.map_keys("reasons")), ","), F.lit("")).alias("reasons"))


def outcome_counts(outcomes, key, not_called=("click",)):
    """Per file: detected and emitted segments, scorer calls and errors, and a map reason -> count."""
    by_reason = outcomes.groupBy(key, "reason").agg(F.count("*").alias("n"))
    r, n = F.col("reason"), F.col("n")
    pairs = F.filter(F.collect_list(F.struct("reason", "n")), lambda x: x["reason"].isNotNull())
    skipped = F.coalesce(r.isin(*not_called), F.lit(False))
    return by_reason.groupBy(key).agg(F.sum("n").alias("detected"), F.sum(F.when(r.isNull(), n).otherwise(0)).alias("emitted"), F.sum(F.when(~skipped, n).otherwise(0)).alias("asr_calls"), F.sum(F.when(r == "error", n).otherwise(0)).alias("asr_errors"), F.map_from_entries(pairs).alias("reasons"))


@query("file_outcome", """
SELECT user_id, calls > 0 AND errors = calls AS failed, NOT (calls > 0 AND errors = calls) success, calls = 0 AS segmentation_empty
FROM (SELECT user_id, count_if(event_type <> 'click' AND event_id % 3 = 0) calls, count_if(event_type = 'error' AND event_id % 3 = 0) errors FROM events GROUP BY user_id)""")
def file_outcome(spark, sf):
    """A file fails only when it has scorer calls and all of them erred."""
    e, mine = S.table(spark, sf, "events"), F.col("event_id") % 3 == 0
    g = e.groupBy("user_id").agg(F.count_if((F.col("event_type") != "click") & mine).alias("calls"), F.count_if((F.col("event_type") == "error") & mine).alias("errors"))
    failed = (F.col("calls") > 0) & (F.col("errors") == F.col("calls"))
    return g.select("user_id", failed.alias("failed"), (~failed).alias("success"), (F.col("calls") == 0).alias("segmentation_empty"))


@query("noise_profile", """
SELECT user_id, round(f, 6) noise_floor_db, round(r, 6) noise_rms_p95_db, round(p, 6) peak_p95_db, round(p + 6, 6) suggested_threshold_db, round(r + 6, 6) suggested_engine_min_rms_dbfs, round(f - 5, 6) danger_low, round(f + 5, 6) danger_high, sample_count, sample_count / 10 duration_s
FROM (SELECT user_id, quantile_cont(db, 0.25) f, quantile_cont(db, 0.95) r, quantile_cont(db + 3, 0.95) p, count(*) sample_count FROM (SELECT user_id, 20 * log10(greatest(value / 500, 1e-10)) db FROM events) GROUP BY user_id)""")
def noise_profile(spark, sf):
    db = F.lit(20) * F.log10(F.greatest(F.col("value") / 500, F.lit(1e-10)))
    e = S.table(spark, sf, "events").select("user_id", db.alias("rms_db"), (db + 3).alias("peak_db"))
    return round_doubles(noise_stats(e, "user_id", 10.0))


def noise_stats(levels, key, rate, peak_margin=6.0, rms_margin=6.0):
    """Noise floor, levels and suggested thresholds per source from rms_db and peak_db."""
    peaks = C.percentiles(levels, [key], "peak_db", [0.95]).select(key, F.col("q")[0].alias("p"))
    g = levels.groupBy(key).agg(F.count("*").alias("sample_count")).join(C.percentiles(levels, [key], "rms_db", [0.25, 0.95]), key).join(peaks, key)
    f, r = F.col("q")[0], F.col("q")[1]
    return g.select(key, f.alias("noise_floor_db"), r.alias("noise_rms_p95_db"), F.col("p").alias("peak_p95_db"), (F.col("p") + peak_margin).alias("suggested_threshold_db"), (r + rms_margin).alias("suggested_engine_min_rms_dbfs"), (f - 5).alias("danger_low"), (f + 5).alias("danger_high"), "sample_count", (F.col("sample_count") / rate).alias("duration_s"))


@query("vad_preset_ranking", "SELECT lang, arg_min(vad, (score, vad, engine)) best_vad, arg_min(engine, (score, vad, engine)) engine, round(min(score), 6) score, count(DISTINCT (vad, engine)) available FROM v_presets GROUP BY lang")
def vad_preset_ranking(spark, sf):
    best = F.min_by(F.struct("vad", "engine", "score"), F.struct("score", "vad", "engine"))
    g = S.presets(spark, sf).groupBy("lang").agg(best.alias("b"), F.count_distinct("vad", "engine").alias("available"))
    return round_doubles(g.select("lang", F.col("b.vad").alias("best_vad"), F.col("b.engine").alias("engine"), F.col("b.score").alias("score"), "available"))


@query("hallucination_metrics", "SELECT source, count(*) entries, CAST(sum(length(text)) AS BIGINT) total_chars FROM documents GROUP BY source")
def hallucination_metrics(spark, sf):
    return longest_runs(S.table(spark, sf, "documents"), "source").drop("longest_run")


def longest_runs(texts, key):
    """Per config: entries, characters, and the longest run of one repeated character."""
    run = F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"(?s)((.)\2*)"), F.lit(1)), F.length))
    return texts.groupBy(key).agg(F.count("*").alias("entries"), F.sum(F.length("text")).alias("total_chars"), F.coalesce(F.max(run), F.lit(0)).alias("longest_run"))


@query("longest_character_run", """
WITH c AS (SELECT source, doc_id, unnest(string_split(text, '')) ch, unnest(range(length(text))) i FROM documents),
r AS (SELECT source, doc_id, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) g FROM c)
SELECT source, max(n) longest_run FROM (SELECT source, count(*) n FROM r GROUP BY source, doc_id, ch, g) GROUP BY source""")
def longest_character_run(spark, sf):
    return longest_runs(S.table(spark, sf, "documents"), "source").select("source", F.col("longest_run").cast("long").alias("longest_run"))


@query("weighted_logprob", """
SELECT source_id, item, round(sum(lp * n) / nullif(sum(n), 0), 6) avg_logprob, string_agg(text, '' ORDER BY turn) AS text
FROM (SELECT source_id, turn // 100000 item, turn, text, -1 / (1 + turn)::DOUBLE lp, length(text) - turn % 3 n FROM v_utt) WHERE text <> '' AND n > 0 GROUP BY source_id, item""")
def weighted_logprob(spark, sf):
    """Pieces of a split input, one turn of a conversation: their mean log-probability by token count, and their texts in order."""
    u = S.utterances(spark, sf).withColumns({"lp": -1 / (1 + F.col("turn")), "n": F.length("text") - F.col("turn") % 3}).filter((F.col("text") != "") & (F.col("n") > 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    item = F.floor(F.col("turn") / 100_000).alias("item")
    return round_doubles(u.groupBy("source_id", item).agg((F.sum(F.col("lp") * F.col("n")) / F.sum("n")).alias("avg_logprob"), text.alias("text")))


@query("token_confidence_mean", "SELECT clip, round(list_avg([CASE WHEN x < -0.2 THEN NULL ELSE x END FOR x IN samples]), 6) token_confidence_mean FROM v_audio")
def token_confidence_mean(spark, sf):
    from cadenza.functions.arrays import mean_of

    tokens = F.transform("samples", lambda x: F.when(x < -0.2, F.lit(None)).otherwise(x))
    return round_doubles(S.audio(spark, sf).select("clip", mean_of(tokens).alias("token_confidence_mean")))
