"""Queries of filters, joins, samples, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions import arrays as A
from cadenza.functions import text as X
from cadenza.operators import gates as G
from cadenza.operators import joins as J
from cadenza.plans import suite as S
from cadenza.plans.suite import query, r6, round_doubles, table
from cadenza.runtime import few

# UI events: raw JSON made from the events table -----------------------------------------------------

S.SQL["v_raw"] = """
SELECT event_id, '{' || array_to_string(list_filter([
 CASE event_id % 8 WHEN 0 THEN '"event_type":"transcription"' WHEN 1 THEN '"event_type":"status"' WHEN 2 THEN '"event_type":"subtitle"' WHEN 3 THEN '"event_type":"odd"' WHEN 4 THEN '"event_type":"error"' WHEN 5 THEN '"event_type":"transcription"' END,
 CASE WHEN event_id % 5 <> 0 THEN '"text":"' || CASE WHEN event_id % 10 = 1 THEN '' ELSE event_type END || '"' END, CASE WHEN event_id % 3 <> 0 THEN '"source_id":"s' || user_id || '"' END, CASE WHEN event_id % 2 = 0 THEN '"is_final":true' END,
 CASE WHEN event_id % 7 <> 0 THEN '"timestamp":' || event_id END, CASE WHEN event_id % 4 = 1 THEN '"status_code":null' WHEN event_id % 4 = 2 THEN '"error_code":"E1"' END, CASE WHEN event_id % 6 <> 0 THEN '"message":"m"' END,
 CASE WHEN event_id % 9 = 0 THEN '"display_text":"shown"' WHEN event_id % 9 = 1 THEN '"metadata":{"text":"meta","timestamp":7}' WHEN event_id % 9 = 2 THEN '"status":"busy"' END,
 CASE WHEN event_id % 4 < 3 THEN '"destination":"' || CASE event_id % 4 WHEN 0 THEN 'obs' WHEN 1 THEN 'vrchat' ELSE 'tv' END || '"' END, CASE WHEN event_id % 2 = 1 THEN '"is_translated":false' END], lambda x: x IS NOT NULL), ',') || '}' AS raw FROM events
"""


def raw_events(spark, sf):
    m = F.col("event_id")
    kind = F.element_at(F.lit(["transcription", "status", "subtitle", "odd", "error", "transcription", None, None]), (m % 8 + 1).cast("int"))
    parts = [
        F.when(kind.isNotNull(), F.concat(F.lit('"event_type":"'), kind, F.lit('"'))),
        F.when(m % 5 != 0, F.concat(F.lit('"text":"'), F.when(m % 10 == 1, "").otherwise(F.col("event_type")), F.lit('"'))),
        F.when(m % 3 != 0, F.concat(F.lit('"source_id":"s'), F.col("user_id").cast("string"), F.lit('"'))),
        F.when(m % 2 == 0, '"is_final":true'),
        F.when(m % 7 != 0, F.concat(F.lit('"timestamp":'), m.cast("string"))),
        F.when(m % 4 == 1, '"status_code":null').when(m % 4 == 2, '"error_code":"E1"'),
        F.when(m % 6 != 0, '"message":"m"'),
        F.when(m % 9 == 0, '"display_text":"shown"').when(m % 9 == 1, '"metadata":{"text":"meta","timestamp":7}').when(m % 9 == 2, '"status":"busy"'),
        F.when(m % 4 < 3, F.concat(F.lit('"destination":"'), F.element_at(F.lit(["obs", "vrchat", "tv"]), (m % 4 + 1).cast("int")), F.lit('"'))),
        F.when(m % 2 == 1, '"is_translated":false'),
    ]
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("raw"))


def _keys(keys):
    return "json_exists(raw, '$.x')" if not keys else " AND ".join(f"list_contains(k, '{x}')" for x in keys)


S.SQL["v_valid"] = "SELECT *, CASE {} WHEN kind IS NULL THEN {} ELSE false END valid FROM (SELECT *, json_keys(raw) k, raw->>'$.event_type' kind FROM v_raw)".format(" ".join(f"WHEN kind = '{t}' THEN {_keys(ks)}" for t, ks in G.REQUIRED.items()), _keys(("text", "source_id")))
S.SQL["v_repaired"] = """SELECT *, coalesce(nullif(raw->>'$.text', ''), nullif(raw->>'$.metadata.text', ''), nullif(raw->>'$.display_text', ''), nullif(raw->>'$.status', '')) AS t, coalesce(raw->>'$.is_final', raw->>'$.metadata.is_final', 'false') = 'true' AS fin,
 CAST(coalesce(raw->>'$.timestamp', raw->>'$.metadata.timestamp') AS DOUBLE) ts FROM v_valid"""


@query("event_validate", "SELECT event_id, valid FROM v_valid")
def event_validate(spark, sf):
    return raw_events(spark, sf).select("event_id", G.valid_event("raw").alias("valid"))


@query("event_rehydrate", "SELECT event_id, t AS text, coalesce(raw->>'$.source_id', 'unknown') source_id, fin is_final, ts AS timestamp, CASE WHEN fin THEN 'final' ELSE 'interim' END phase FROM v_repaired WHERE kind = 'transcription' AND t IS NOT NULL")
def event_rehydrate(spark, sf):
    e = raw_events(spark, sf).filter(F.get_json_object("raw", "$.event_type") == "transcription").select("event_id", G.rehydrate("raw").alias("e"))
    return e.filter("e is not null").select("event_id", "e.*")


@query("event_normalize", """
SELECT event_id, CASE WHEN list_contains(k, 'event_type') THEN CASE WHEN valid THEN kind WHEN kind = 'transcription' AND t IS NOT NULL THEN 'transcription' END
 WHEN list_contains(k, 'text') AND list_contains(k, 'source_id') THEN 'transcription' WHEN list_contains(k, 'status_code') AND list_contains(k, 'message') THEN 'status' WHEN list_contains(k, 'error_code') AND list_contains(k, 'message') THEN 'error' END kind FROM v_repaired""")
def event_normalize(spark, sf):
    return raw_events(spark, sf).select("event_id", G.route("raw").alias("kind"))


@query("translation_event_check", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'ja' END <> CASE WHEN turn % 3 = 0 THEN 'en' ELSE 'de' END AS valid FROM conversations")
def translation_event_check(spark, sf):
    c = table(spark, sf, "conversations")
    source, target = F.when(F.col("conv_id") % 2 == 0, "en").otherwise("ja"), F.when(F.col("turn") % 3 == 0, "en").otherwise("de")
    return c.select("conv_id", "turn", G.valid_translation(source, target).alias("valid"))


@query("subtitle_event_check", "SELECT event_id, coalesce(raw->>'$.destination' IN ('obs', 'vrchat'), false) valid FROM v_raw")
def subtitle_event_check(spark, sf):
    return raw_events(spark, sf).select("event_id", G.valid_destination(F.get_json_object("raw", "$.destination")).alias("valid"))


S.SQL["v_decided"] = """
SELECT *, CASE WHEN no_speech_prob > 0.71 THEN 'no_speech_prob' WHEN token_confidence_mean < 0.001 THEN 'token_confidence_mean'
 WHEN no_speech_prob IS NULL AND token_confidence_mean IS NULL AND avg_logprob < CASE WHEN engine_name LIKE 'Reazon%' THEN -0.40 WHEN engine_name LIKE 'Qwen3%' THEN -0.42 ELSE -1.0 END THEN 'avg_logprob' END reason FROM v_signals"""


@query("confidence_filter", "SELECT event_id, reason IS NOT NULL rejected, reason FROM v_decided")
def confidence_filter(spark, sf):
    return S.signals(spark, sf).withColumn("reason", G.rejected_by()).select("event_id", F.col("reason").isNotNull().alias("rejected"), "reason")


@query("confidence_filter_mode", """
SELECT 'off' AS mode, count(*) kept, 0::BIGINT logged FROM v_decided UNION ALL SELECT 'observe', count(*), count(*) FROM v_decided UNION ALL SELECT 'on', count_if(reason IS NULL), count_if(reason IS NOT NULL) FROM v_decided""")
def confidence_filter_mode(spark, sf):
    out = None
    for mode in G.MODES:
        kept, log = G.filter_outputs(S.signals(spark, sf), mode)
        both = kept.select(F.lit(1).alias("k"), F.lit(0).alias("l")).union(log.select(F.lit(0), F.lit(1)))
        row = both.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("kept"), F.coalesce(F.sum("l"), F.lit(0)).alias("logged")).select(F.lit(mode).alias("mode"), "kept", "logged")
        out = row if out is None else out.union(row)
    return out


@query("engine_key_short", "SELECT s_suppkey, lower(regexp_extract(trim(s_name), '^\\S+')) AS key FROM supplier")
def engine_key_short(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", X.first_word("s_name").alias("key"))


@query("engine_key_canonical", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'reazonspeech' WHEN event_id % 4 = 1 THEN 'qwen3asr' WHEN event_id % 4 = 2 THEN 'parakeet_ja' ELSE 'whispers2t' END engine_id FROM events")
def engine_key_canonical(spark, sf):
    return S.signals(spark, sf).select("event_id", X.engine_id("engine_name").alias("engine_id"))


LEVEL = "20 * log10(greatest(list_max([sqrt(list_sum([x * x FOR x IN samples[i * 8 + 1:i * 8 + 8]]) / 8) FOR i IN range(8)]), 1e-10))"


@query("energy_gate", f"SELECT clip, round({LEVEL}, 6) dbfs FROM v_audio WHERE {LEVEL} >= -14")
def energy_gate(spark, sf):
    a = S.audio(spark, sf).withColumn("dbfs", A.energy_dbfs("samples", 8))
    return a.filter(G.energy_passes(F.col("dbfs"), -14.0)).select("clip", r6("dbfs"))


S.SQL["v_outcome"] = """
SELECT event_id, source_id, CASE WHEN event_id % 31 = 0 THEN 'empty_audio' WHEN value < 2 THEN 'energy_gate' WHEN event_type = 'error' THEN 'engine_error:Timeout' WHEN reason IS NOT NULL THEN 'filter_reject' WHEN text = '' THEN 'engine_empty' END drop_reason, text FROM v_decided"""


def outcomes(spark, sf):
    s = S.signals(spark, sf)
    reason = G.drop_reason(F.col("event_id") % 31 == 0, ~G.energy_passes(F.col("value"), 2.0), F.when(F.col("event_type") == "error", "Timeout"), G.rejected_by().isNotNull(), F.col("text"))
    return s.select("event_id", "source_id", reason.alias("drop_reason"), "text")


@query("drop_reason", "SELECT event_id, drop_reason FROM v_outcome")
def drop_reason(spark, sf):
    return outcomes(spark, sf).select("event_id", "drop_reason")


@query("outcome_invariants", """
SELECT event_id, array_to_string(list_filter([CASE WHEN drop_reason IS NOT NULL AND text <> '' THEN 'reason_with_text' END, CASE WHEN drop_reason = 'energy_gate' AND event_id % 2 = 0 THEN 'energy_after_call' END,
 CASE WHEN drop_reason IN ('filter_reject', 'engine_empty') AND event_id % 2 = 1 THEN 'reject_without_call' END, CASE WHEN drop_reason IS NULL AND event_id % 2 = 1 THEN 'emitted_without_call' END], lambda x: x IS NOT NULL), ',') AS violations FROM v_outcome
WHERE (drop_reason IS NOT NULL AND text <> '') OR (drop_reason = 'energy_gate' AND event_id % 2 = 0) OR (drop_reason IN ('filter_reject', 'engine_empty') AND event_id % 2 = 1) OR (drop_reason IS NULL AND event_id % 2 = 1)""")
def outcome_invariants(spark, sf):
    v = G.outcome_violations(F.col("drop_reason"), F.col("text"), F.col("event_id") % 2 == 0)
    return outcomes(spark, sf).select("event_id", F.array_join(v, ",").alias("violations")).filter("violations != ''")


TARGET, SPEECH = [3, 4, 5, 6, 7], [0, 1, 2]


@query("reject_score_policies", "SELECT win, round(list_max(probs[4:8]), 6) AS max, round(list_sum(probs[4:8]), 6) AS sum, round(list_max(probs[4:8]) - list_max(probs[1:3]), 6) + 0.0 target_minus_speech FROM v_class")
def reject_score_policies(spark, sf):
    p = A.policies("probs", TARGET, SPEECH, 64)
    return S.class_windows(spark, sf).select("win", *(r6(c, n) for n, c in p.items()))


@query("language_compatible", """
SELECT doc_id, 'canary' engine_id FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') AND doc_id % 3 = 0 UNION ALL SELECT doc_id, 'parakeet' FROM documents WHERE lang = 'en' AND doc_id % 3 = 1 UNION ALL SELECT doc_id, 'unknown' FROM documents WHERE doc_id % 3 = 2""")
def language_compatible(spark, sf):
    e = F.when(F.col("doc_id") % 3 == 0, "canary").when(F.col("doc_id") % 3 == 1, "parakeet").otherwise("unknown")
    return J.compatible(table(spark, sf, "documents").select("doc_id", "lang", e.alias("engine_id")), S.engines(spark), "lang").select("doc_id", "engine_id")


def keep_categories(df, column, wanted):
    """Rows of the wanted categories; a wanted one that never occurs is an error."""
    there = {r[0] for r in df.filter(F.col(column).isin(*wanted)).select(column).distinct().collect()}  # at most len(wanted) rows
    if missing := sorted(set(wanted) - there):
        raise ValueError(f"unknown categories: {missing}")
    return df.filter(F.col(column).isin(*wanted))


def part_categories(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", F.element_at(F.split("p_type", " "), 1).alias("category"))


@query("category_filter", "SELECT p_partkey, split_part(p_type, ' ', 1) category FROM part WHERE split_part(p_type, ' ', 1) IN ('PROMO', 'ECONOMY')")
def category_filter(spark, sf):
    return keep_categories(part_categories(spark, sf), "category", ["PROMO", "ECONOMY"]).select("p_partkey", "category")


# joins --------------------------------------------------------------------------------------------

S.SQL["v_log"] = "SELECT source_id, turn, text, row_number() OVER (PARTITION BY source_id ORDER BY turn) - 1 occurrence FROM v_utt WHERE turn % 4 <> 3"
S.SQL["v_labels"] = """
SELECT source_id * 1000000000 + turn line_no, source_id, CASE turn % 5 WHEN 0 THEN 'speech' WHEN 1 THEN 'non_speech' WHEN 2 THEN 'noisy_speech' WHEN 3 THEN 'odd' ELSE 'speech' END AS label,
 CASE WHEN source_id % 4 = 1 THEN text END AS text, CASE WHEN source_id % 4 = 2 THEN turn // 2 END AS occurrence_index FROM v_utt WHERE source_id % 4 <> 0"""


def observed(spark, sf):
    """Final utterances with their running number per source (filtered rows use up no number)."""
    u = S.utterances(spark, sf).filter("is_final")
    return u.withColumn("occurrence", (F.row_number().over(W.partitionBy("source_id").orderBy("turn")) - 1).cast("long"))


def label_lines(spark, sf):
    u, m = S.utterances(spark, sf).filter("source_id % 4 != 0"), F.col("source_id") % 4
    label = F.element_at(F.lit(["speech", "non_speech", "noisy_speech", "odd", "speech"]), (F.col("turn") % 5 + 1).cast("int"))
    return u.select((F.col("source_id") * 1_000_000_000 + F.col("turn")).alias("line_no"), "source_id", label.alias("label"), F.when(m == 1, F.col("text")).alias("text"), F.when(m == 2, F.floor(F.col("turn") / 2)).alias("occurrence_index"))


@query("join_label_cascade", """
WITH occ AS (SELECT source_id, occurrence_index occurrence, arg_max(label, line_no) l1 FROM v_labels WHERE occurrence_index IS NOT NULL GROUP BY ALL), txt AS (SELECT source_id, text, arg_max(label, line_no) l2 FROM v_labels WHERE occurrence_index IS NULL AND coalesce(text, '') <> '' GROUP BY ALL),
src AS (SELECT source_id, arg_max(label, line_no) l3 FROM v_labels WHERE occurrence_index IS NULL AND coalesce(text, '') = '' AND source_id NOT IN (SELECT source_id FROM v_labels WHERE occurrence_index IS NOT NULL OR coalesce(text, '') <> '') GROUP BY ALL)
SELECT source_id, turn, coalesce(l1, CASE WHEN text <> '' THEN l2 END, l3) AS label FROM v_log LEFT JOIN occ USING (source_id, occurrence) LEFT JOIN txt USING (source_id, text) LEFT JOIN src USING (source_id)
WHERE coalesce(l1, CASE WHEN text <> '' THEN l2 END, l3) IN ('speech', 'non_speech', 'noisy_speech')""")
def join_label_cascade(spark, sf):
    return J.label_cascade(observed(spark, sf).select("source_id", "turn", "text", "occurrence"), label_lines(spark, sf)).select("source_id", "turn", "label")


def measured(spark, sf, cut):
    d = S.samples(spark, sf)
    return d.select(F.col("doc_id").alias("path"), "label", (F.col("doc_id") % cut == 0).alias("error"), F.concat("text", F.lit(f" {cut}")).alias("text"), "doc_id")


@query("join_pairwise_by_path", "SELECT doc_id AS path, text || ' 11' text_a, text || ' 13' text_b FROM v_samples WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND label <> 'non_speech'")
def join_pairwise_by_path(spark, sf):
    b = measured(spark, sf, 13)
    twice = b.unionByName(b.withColumns({"doc_id": F.col("doc_id") - 1_000_000, "text": F.lit("stale")}))
    return J.pairs_by_path(measured(spark, sf, 11), twice, "doc_id")


@query("join_audio_transcript", "SELECT doc_id, quality IS NOT NULL matched FROM documents LEFT JOIN labels USING (doc_id)")
def join_audio_transcript(spark, sf):
    """Clips with a transcript, and those without as a report."""
    d, t = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.join(t, "doc_id").withColumn("matched", F.lit(True)).union(d.join(t, "doc_id", "left_anti").withColumn("matched", F.lit(False)))


@query("join_skip_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_skip_existing(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


SNRS = [-5.0, 0.0, 10.0]
S.SQL["v_mixpairs"] = """
SELECT doc_id, vec_id, snr FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 i, count(*) OVER () n FROM v_samples WHERE label = 'speech') s
JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 j, count(*) OVER () p FROM embeddings) e ON j = CASE WHEN n > p THEN CAST(floor(i * p / n) AS BIGINT) WHEN n > 1 THEN CAST(round_even(i * (p - 1) / (n - 1), 0) AS BIGINT) ELSE 0 END, (VALUES (-5.0), (0.0), (10.0)) t(snr)"""


def mix_pairs(spark, sf):
    """The i-th speech clip with the noise clip at an even stride in the sorted pool, at each SNR."""
    s = S.samples(spark, sf).filter("label = 'speech'").select("doc_id")
    e = S.audio(spark, sf).select(F.col("clip").alias("vec_id"))
    n, p = F.lit(s.count()), F.lit(e.count())
    s = J.numbered(s, ["doc_id"], "i").withColumn("j", J.stride_position(F.col("i"), n, p))
    return s.join(J.numbered(e, ["vec_id"], "j"), "j").select("doc_id", "vec_id", F.explode(F.lit(SNRS)).alias("snr"))


@query("join_speech_noise_pairs", "SELECT doc_id, vec_id, snr::DOUBLE snr FROM v_mixpairs")
def join_speech_noise_pairs(spark, sf):
    return mix_pairs(spark, sf)


S.SQL["v_spans"] = "SELECT source_id, frame_idx segment, ts_s AS start, ts_s + 0.1::DOUBLE * (1 + frame_idx % 5) AS stop FROM v_frames WHERE frame_idx % 20 = 0"


@query("join_segment_frames", "SELECT s.source_id, segment, count(*) n, round(avg(p), 6) mean_p FROM v_spans s JOIN v_frames f ON s.source_id = f.source_id AND ts_s >= start AND ts_s < stop GROUP BY s.source_id, segment")
def join_segment_frames(spark, sf):
    f = S.frames(spark, sf).select("source_id", F.col("ts_s").alias("t"), "p", "frame_idx")
    seg = f.filter("frame_idx % 20 = 0").select("source_id", F.col("frame_idx").alias("segment"), F.col("t").alias("start"), (F.col("t") + 0.1 * (1 + F.col("frame_idx") % 5)).alias("end"))
    return round_doubles(J.inside_segments(f.select("source_id", "t", "p"), seg, 0.5).groupBy("source_id", "segment").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p")))


@query("join_preset_lookup", """
WITH q AS (SELECT vad, lang, engine FROM v_presets WHERE score < 950 UNION ALL SELECT DISTINCT vad, lang, NULL FROM v_presets UNION ALL SELECT DISTINCT vad, lang, 'nobody' FROM v_presets),
b AS (SELECT vad, lang, arg_min(engine, (score, engine)) e, min(score) s FROM v_presets GROUP BY ALL)
SELECT q.vad, q.lang, q.engine asked, CASE WHEN q.engine IS NULL THEN e ELSE p.engine END engine, CASE WHEN q.engine IS NULL THEN s ELSE score END score FROM q LEFT JOIN v_presets p ON q.vad = p.vad AND q.lang = p.lang AND q.engine = p.engine JOIN b ON q.vad = b.vad AND q.lang = b.lang""")
def join_preset_lookup(spark, sf):
    p = S.presets(spark, sf)
    keys = p.select("vad", "lang").distinct()
    q = p.filter("score < 950").select("vad", "lang", "engine").union(keys.withColumn("engine", F.lit(None).cast("string"))).union(keys.withColumn("engine", F.lit("nobody")))
    return J.preset_for(q, p)


@query("join_language_candidates", "SELECT lang, engine_id, count(*) n FROM documents JOIN (SELECT engine_id, unnest(languages) lang FROM v_engines) USING (lang) GROUP BY lang, engine_id")
def join_language_candidates(spark, sf):
    e = S.engines(spark).select("engine_id", F.explode("languages").alias("lang"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).join(few(e), "lang").select("lang", "engine_id", "n")


# sorts, top rows, samples ---------------------------------------------------------------------------


@query("natural_sort", "SELECT c_custkey, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT), c_custkey) place FROM customer")
def natural_sort(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", X.natural_key("c_name").alias("k"))
    return J.numbered(c, ["k", "c_custkey"], "i").select("c_custkey", (F.col("i") + 1).alias("place"))


def first_n(df, by, order, n):
    return df.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


#: Rows per language of each dataset mode; full has no limit.
MODE_LIMITS = {"quick": 30, "standard": 100, "full": None}


@query("mode_limited_dataset", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR)) r FROM documents) WHERE r <= 30")
def mode_limited_dataset(spark, sf):
    return first_n(table(spark, sf, "documents").select("doc_id", "lang"), "lang", [F.col("doc_id").cast("string")], MODE_LIMITS["quick"])


@query("first_n_per_category", "SELECT p_partkey, category FROM (SELECT p_partkey, split_part(p_type, ' ', 1) category, row_number() OVER (PARTITION BY split_part(p_type, ' ', 1) ORDER BY p_name, p_partkey) r FROM part) WHERE r <= 5")
def first_n_per_category(spark, sf):
    return first_n(part_categories(spark, sf), "category", ["p_name", "p_partkey"], 5).select("p_partkey", "category")


def first_rows(df, n, order, what):
    """The first n rows by order; fewer are an error."""
    out = df.orderBy(order).limit(n)
    if (found := out.count()) < n:
        raise ValueError(f"{found} {what} found, {n} needed")
    return out


@query("speech_sample_top_n", "SELECT doc_id FROM v_samples WHERE label = 'speech' AND lang = 'en' ORDER BY doc_id LIMIT 20")
def speech_sample_top_n(spark, sf):
    return first_rows(S.samples(spark, sf).filter("label = 'speech' and lang = 'en'").select("doc_id"), 20, "doc_id", "speech samples")


@query("uniform_stride_sample", """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 j, count(*) OVER () p FROM documents) SELECT DISTINCT doc_id FROM d, (SELECT unnest(range(50)) i) WHERE j = CAST(round_even(i * (p - 1) / 49, 0) AS BIGINT)""")
def uniform_stride_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    n = d.count()
    wanted = spark.range(50).select(J.stride_position(F.col("id"), F.lit(50), F.lit(n)).alias("j")).distinct()
    return J.numbered(d, ["doc_id"], "j").join(F.broadcast(wanted), "j", "left_semi").select("doc_id")


# sets -----------------------------------------------------------------------------------------------


@query("corpus_union", "SELECT 'documents' corpus, count(*) n, CAST(sum(length(text)) AS BIGINT) chars, count(lang) with_lang FROM documents UNION ALL SELECT 'benchmark', count(*), CAST(sum(length(text)) AS BIGINT), 0 FROM benchmark")
def corpus_union(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("documents").alias("corpus"), "doc_id", "text", "lang")
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("corpus"), "item_id", "text")
    return d.unionByName(b, allowMissingColumns=True).groupBy("corpus").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count("lang").alias("with_lang"))


@query("sweep_space", "SELECT preset, filter_mode, backend, engine, corpus FROM (SELECT DISTINCT preset FROM v_cells), (VALUES ('off'), ('observe'), ('on')) m(filter_mode), (SELECT DISTINCT backend FROM v_cells), (SELECT DISTINCT engine FROM v_cells), (SELECT DISTINCT corpus FROM v_cells)")
def sweep_space(spark, sf):
    """All combinations of the configured values: one row of value lists, exploded."""
    lists = S.cells(spark, sf).agg(*(F.collect_set(c).alias(c) for c in ("preset", "backend", "engine", "corpus"))).withColumn("filter_mode", F.lit(list(G.MODES)))
    for c in ("preset", "filter_mode", "backend", "engine", "corpus"):
        lists = lists.withColumn(c, F.explode(c))
    return lists.select("preset", "filter_mode", "backend", "engine", "corpus")


@query("engine_language_pairs", "SELECT DISTINCT engine, language FROM v_results")
def engine_language_pairs(spark, sf):
    return S.results(spark, sf).select("engine", "language").distinct().orderBy("engine", "language")


@query("finalized_plus_queued", "SELECT source_id, turn, text FROM v_utt WHERE is_final")
def finalized_plus_queued(spark, sf):
    """Returned finals and queued finals; interim results are in neither."""
    u = S.utterances(spark, sf).filter("is_final").select("source_id", "turn", "text")
    return u.filter("turn % 2 = 0").union(u.filter("turn % 2 = 1"))
