"""Queries of window functions and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions import arrays as A
from cadenza.functions import text as X
from cadenza.operators import calibration as C
from cadenza.operators import joins as J
from cadenza.operators import segments as G
from cadenza.operators.windows import numbered_within, over_cells
from cadenza.plans import suite as S
from cadenza.plans.rows import mix_pairs, observed
from cadenza.plans.suite import query, r6, round_doubles, table

# windows --------------------------------------------------------------------------------------------


@query("occurrence_index", "SELECT source_id, turn, occurrence FROM v_log")
def occurrence_index(spark, sf):
    return observed(spark, sf).select("source_id", "turn", "occurrence")


@query("manifest_last_wins", "SELECT path, arg_max(doc_id, doc_id) doc_id, min(doc_id) first_seen FROM (SELECT doc_id, 'p' || (doc_id % 300) AS path FROM documents) GROUP BY path")
def manifest_last_wins(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("p"), (F.col("doc_id") % 300).cast("string")).alias("path"))
    w = W.partitionBy("path").orderBy(F.desc("doc_id"))
    seen = F.min("doc_id").over(W.partitionBy("path"))
    return m.withColumns({"first_seen": seen, "r": F.row_number().over(w)}).filter("r = 1").select("path", "doc_id", "first_seen")


BASELINE = "CASE WHEN frame_idx = 0 THEN 0 ELSE quantile_cont(value, 0.5) OVER (PARTITION BY source_id ORDER BY frame_idx ROWS BETWEEN 31 PRECEDING AND 1 PRECEDING) END"


#: Frames before an onset whose median is its baseline.
REACH = 31


def with_baseline(frames, value="value", size=G.CELL):
    """frames with the median of the values of the frames before, 31 at most; zero for none."""
    median = lambda w: {"baseline": F.coalesce(F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-REACH, -1)), F.lit(0.0))}
    return over_cells(frames, ["source_id"], "frame_idx", REACH, median, size)


@query("onset_baseline", f"SELECT source_id, frame_idx, round(coalesce({BASELINE}, 0), 6) baseline FROM v_frames")
def onset_baseline(spark, sf):
    return with_baseline(S.frames(spark, sf)).select("source_id", "frame_idx", r6("baseline"))


def with_previous(df, keys, order, value, name, size=G.CELL):
    """df with the value of the row before in its series, which is numbered in ranges and cut into cells."""
    d = numbered_within(df, keys, order, "__i")
    return over_cells(d, keys, "__i", 1, lambda w: {name: F.lag(value).over(w)}, size).drop("__i")


@query("spectral_flux", """
SELECT clip, round(coalesce(list_sum([greatest(samples[i] - prev[i], 0) FOR i IN generate_series(1, 64)]), 0), 6) + 0.0 flux FROM (SELECT clip, samples, lag(samples) OVER (PARTITION BY label ORDER BY clip) prev FROM v_audio)""")
def spectral_flux(spark, sf):
    d = with_previous(S.audio(spark, sf), ["label"], ["clip"], "samples", "prev")
    return d.select("clip", r6(A.flux("samples", "prev"), "flux"))


S.SQL["v_features"] = f"""
SELECT source_id, frame_idx, value, 20 * log10(greatest(value / 500, 1e-10)) rms_db, p flatness, value * 100 centroid, (event_id % 10) / 10 zcr, value onset, coalesce({BASELINE}, 0) baseline, (event_id % 7) / 10 voiced FROM v_frames"""
#: The six tests of a transient, and the frames before any counts.
TESTS = {"loud": ("rms_db", ">", -35.0), "flat": ("flatness", ">", 0.30), "high": ("centroid", ">", 2500.0), "noisy": ("zcr", ">", 0.12), "onset_over": ("onset", ">", None), "unvoiced": ("voiced", "<", 0.25)}
ONSET_RATIO, WARM_UP = 3.0, 8


def features(spark, sf):
    m = F.col("event_id")
    f = with_baseline(S.frames(spark, sf))
    return f.select("source_id", "frame_idx", "value", (20 * F.log10(F.greatest(F.col("value") / 500, F.lit(1e-10)))).alias("rms_db"), F.col("p").alias("flatness"), (F.col("value") * 100).alias("centroid"), (m % 10 / 10).alias("zcr"), F.col("value").alias("onset"), "baseline", (m % 7 / 10).alias("voiced"))


def transient_tests():
    out = {}
    for name, (c, op, v) in TESTS.items():
        limit = F.col("baseline") * ONSET_RATIO if v is None else F.lit(v)
        out[name] = F.col(c) > limit if op == ">" else F.col(c) < limit
    return out


def flagged():
    ok = F.col("frame_idx") >= WARM_UP
    for c in transient_tests().values():
        ok = ok & c
    return ok


SQL_TESTS = {"loud": "rms_db > -35", "flat": "flatness > 0.3", "high": "centroid > 2500", "noisy": "zcr > 0.12", "onset_over": "onset > baseline * 3", "unvoiced": "voiced < 0.25"}
S.SQL["v_flags"] = f"SELECT *, frame_idx >= 8 AND {' AND '.join(SQL_TESTS.values())} flag FROM v_features"


@query("transient_flag", "SELECT source_id, frame_idx, flag FROM v_flags")
def transient_flag(spark, sf):
    return features(spark, sf).select("source_id", "frame_idx", flagged().alias("flag"))


@query("transient_telemetry", "SELECT source_id, count(*) frames, {}, count_if(flag) flagged FROM v_flags GROUP BY source_id".format(", ".join(f"count_if({c}) {n}" for n, c in SQL_TESTS.items())))
def transient_telemetry(spark, sf):
    f = features(spark, sf).withColumn("flag", flagged())
    return f.groupBy("source_id").agg(F.count("*").alias("frames"), *(F.count_if(c).alias(n) for n, c in transient_tests().items()), F.count_if("flag").alias("flagged"))


@query("transient_mask", "SELECT source_id, frame_idx, CASE WHEN flag THEN 0 ELSE value END masked, value observed FROM v_flags")
def transient_mask(spark, sf):
    f = features(spark, sf)
    return f.select("source_id", "frame_idx", F.when(flagged(), 0.0).otherwise(F.col("value")).alias("masked"), F.col("value").alias("observed"))


def context_of(rows, n, text="text", key="source_id", order="turn", most=100, size=G.CELL, own=False):
    """(key, order, context): the texts of the n previous rows of a source (at most ``most``), joined by newlines; null for none. own: with the row's text."""
    n = min(n, most)
    kept = [key, order, *([text] if own else [])]
    if n == 0:
        return rows.select(*kept, F.lit(None).cast("string").alias("context"))
    joined = lambda w: {"context": F.nullif(F.array_join(F.collect_list(text).over(w.rowsBetween(-n, -1)), "\n"), F.lit(""))}
    d = numbered_within(rows.select(key, order, text), [key], [order], "__i")
    return over_cells(d, [key], "__i", n, joined, size).select(*kept, "context")


@query("context_window", "SELECT source_id, turn, array_to_string(list(text) OVER (PARTITION BY source_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)) context FROM v_utt")
def context_window(spark, sf):
    return context_of(S.utterances(spark, sf), 2)


@query("subtitle_index", "SELECT source_id, turn, idx FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY turn) idx FROM v_utt) WHERE turn % 3 <> 1")
def subtitle_index(spark, sf):
    """Numbered before segments are dropped, so drops leave gaps."""
    u = numbered_within(S.utterances(spark, sf).select("source_id", "turn"), ["source_id"], ["turn"], "idx", start=1)
    return u.filter("turn % 3 != 1").select("source_id", "turn", "idx")


@query("engine_ranking", """
WITH c AS (SELECT p_type, p_partkey, p_size % 4 quality, CASE WHEN p_retailprice > 1500 * 0.9 THEN 0 ELSE 1 END fit, p_partkey % 3 latency, p_size % 2 stream, p_retailprice > 1500 * 0.9 AS over FROM part)
SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY quality DESC, fit DESC, latency DESC, stream DESC, p_partkey) place,
 array_to_string(list_filter([CASE WHEN quality >= 3 THEN 'quality' END, CASE WHEN over THEN 'vram_over' ELSE 'vram_ok' END, CASE WHEN latency >= 2 THEN 'fast' END, CASE WHEN stream = 1 THEN 'streaming' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def engine_ranking(spark, sf):
    """Parts as candidate engines of each request (part type): VRAM is the price against 1500 with a margin of 0.9."""
    over = F.col("p_retailprice") > 1500 * 0.9
    c = table(spark, sf, "part").select("p_type", "p_partkey", (F.col("p_size") % 4).alias("quality"), over.alias("over"), (F.col("p_partkey") % 3).alias("latency"), (F.col("p_size") % 2).alias("streaming"))
    return rank_engines(c, "p_type", "p_partkey").select("p_type", "p_partkey", "place", F.array_join("reasons", ",").alias("reasons"))


def rank_engines(candidates, request, registered):
    """Rank by quality, fit into VRAM, latency and streaming, then order of registration; with reason codes. Too large engines sink but stay."""
    w = W.partitionBy(request).orderBy(F.desc("quality"), F.col("over").cast("int"), F.desc("latency"), F.desc("streaming"), registered)
    reasons = F.array_compact(F.array(F.when(F.col("quality") >= 3, "quality"), F.when(F.col("over"), "vram_over").otherwise("vram_ok"), F.when(F.col("latency") >= 2, "fast"), F.when(F.col("streaming") == 1, "streaming")))
    return candidates.withColumns({"place": F.row_number().over(w), "reasons": reasons})


S.SQL["v_islands"] = """
SELECT source_id, min(frame_idx) a, max(frame_idx) + 1 b FROM (SELECT *, sum(nw) OVER (PARTITION BY source_id ORDER BY frame_idx) g FROM (SELECT source_id, frame_idx, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY source_id ORDER BY frame_idx) - 1 < 3 THEN 0 ELSE 1 END nw FROM v_frames WHERE p >= 0.5)) GROUP BY source_id, g"""


@query("hysteresis_segments", """
WITH r AS (SELECT source_id, a, b, ceil((b - a) / 12)::BIGINT k FROM v_islands WHERE b - a >= 2), s AS (SELECT source_id, a, b, k, (b - a) // k sz, unnest(range(k)) j FROM r)
SELECT * FROM (SELECT source_id, a + j * sz start_frame, CASE WHEN j = k - 1 THEN b ELSE a + (j + 1) * sz END end_frame FROM s) WHERE end_frame - start_frame >= 2""")
def hysteresis_segments(spark, sf):
    return G.hysteresis_segments(S.frames(spark, sf), 0.5, 3, 2, 12)


@query("segment_statistics", """
SELECT source_id, count(*) segments, round(sum(b - a) * 0.032, 6) speech_s, round(sum(b - a) / max(n), 6) speech_ratio, round(avg(b - a) * 0.032, 6) mean_segment_s FROM v_islands JOIN (SELECT source_id, count(*) n FROM v_frames GROUP BY source_id) USING (source_id) GROUP BY source_id""")
def segment_statistics(spark, sf):
    f = S.frames(spark, sf)
    seg = G.hysteresis_segments(f, 0.5, 3).withColumn("d", F.col("end_frame") - F.col("start_frame"))
    n = f.groupBy("source_id").agg(F.count("*").alias("n"))
    g = seg.groupBy("source_id").agg(F.count("*").alias("segments"), F.sum("d").alias("s"), F.avg("d").alias("m")).join(n, "source_id")
    return round_doubles(g.select("source_id", "segments", (F.col("s") * G.FRAME_S).alias("speech_s"), (F.col("s") / F.col("n")).alias("speech_ratio"), (F.col("m") * G.FRAME_S).alias("mean_segment_s")))


# class scores ----------------------------------------------------------------------------------------

S.SQL["v_pooled"] = "SELECT clip, class, max(x) score, any_value(negative) negative FROM (SELECT clip, negative, unnest(probs) x, unnest(range(64)) class FROM v_class) GROUP BY clip, class"


def pooled(spark, sf):
    """Largest score of each class over a clip's windows, in long form."""
    return S.class_windows(spark, sf).select("clip", "negative", F.posexplode("probs").alias("class", "x")).groupBy("clip", "class").agg(F.max("x").alias("score"), F.any_value("negative").alias("negative"))


@query("clip_max_pool", "SELECT clip, array_to_string(list(printf('%.6f', score) ORDER BY class), ',') AS pooled FROM v_pooled GROUP BY clip")
def clip_max_pool(spark, sf):
    vec = F.array_sort(F.collect_list(F.struct("class", "score")))
    return pooled(spark, sf).groupBy("clip").agg(F.array_join(F.transform(vec, lambda x: F.format_string("%.6f", x["score"])), ",").alias("pooled"))


@query("class_metrics", """
SELECT class, count_if(negative AND score >= 0.42) tp, count_if(NOT negative AND score >= 0.42) fp, count_if(negative AND score < 0.42) fn, count_if(NOT negative AND score < 0.42) tn,
 round(coalesce(count_if(negative AND score >= 0.42) / nullif(count_if(score >= 0.42), 0), 0), 6) AS "precision", round(coalesce(count_if(negative AND score >= 0.42) / nullif(count_if(negative), 0), 0), 6) recall FROM v_pooled GROUP BY class""")
def class_metrics(spark, sf):
    pos, hit = F.col("negative"), F.col("score") >= 0.42
    g = pooled(spark, sf).groupBy("class").agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn"))
    tp = F.col("tp")
    return round_doubles(g.withColumns({"precision": C.ratio(tp, tp + F.col("fp")), "recall": C.ratio(tp, tp + F.col("fn"))}))


S.SQL["v_scores"] = """
SELECT clip, policy, max(s) s, any_value(negative) neg FROM (SELECT clip, negative, unnest(['max', 'sum', 'target_minus_speech']) policy, unnest([list_max(probs[4:8]), list_sum(probs[4:8]), list_max(probs[4:8]) - list_max(probs[1:3])]) s FROM v_class) GROUP BY clip, policy"""
S.SQL["v_curve"] = "SELECT policy, i / 20 threshold, count_if(neg AND s >= i / 20) tp, count_if(NOT neg AND s >= i / 20) fp, count_if(neg) pos FROM v_scores, (SELECT unnest(generate_series(0, 30)) i) GROUP BY policy, i"
CURVE_GRID = [i / 20 for i in range(31)]


def scores(spark, sf):
    """The reject score of every clip by every policy: its largest window."""
    p = A.policies("probs", [3, 4, 5, 6, 7], [0, 1, 2])
    w = S.class_windows(spark, sf).select("clip", "negative", F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), c.alias("s")) for n, c in p.items()))).alias("x")).select("clip", "negative", "x.*")
    return w.groupBy("clip", "policy").agg(F.max("s").alias("s"), F.any_value("negative").alias("negative"))


def curve(spark, sf):
    """Per policy and threshold: rejected clips (score >= threshold) against negatives; the same histogram sweep as for signals."""
    clips = scores(spark, sf)
    # at least t is not less than t: a sweep of "less" counts what is kept
    kept = C.threshold_sweep(clips, CURVE_GRID, "less", "s", ["policy"], pos=F.col("negative"))
    k = kept.select("policy", "threshold", F.col("fn").alias("tp"), F.col("tn").alias("fp"), (F.col("tp") + F.col("fn")).alias("pos"))
    return k.withColumns({"precision": C.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": C.ratio(F.col("tp"), F.col("pos"))})


CURVE_RATES = 'coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(pos, 0), 0) recall'


@query("reject_curve", f'SELECT policy, threshold, tp, fp, round("precision", 6) "precision", round(recall, 6) recall FROM (SELECT *, {CURVE_RATES} FROM v_curve)')
def reject_curve(spark, sf):
    return round_doubles(curve(spark, sf).select("policy", "threshold", "tp", "fp", "precision", "recall"))


TARGET, FLOORS = "c3", (0.70, 0.50)


@query("gate_verdict", f"""
WITH c AS (SELECT *, {CURVE_RATES} FROM v_curve), t AS (SELECT policy, max(s) target FROM v_scores WHERE clip = '{TARGET}' GROUP BY policy),
ok AS (SELECT *, CASE policy WHEN 'max' THEN 0 WHEN 'sum' THEN 1 ELSE 2 END o FROM c JOIN t USING (policy) WHERE "precision" >= {FLOORS[0]} AND recall >= {FLOORS[1]} AND target >= threshold),
b AS (SELECT * FROM ok ORDER BY recall DESC, "precision" DESC, policy DESC, threshold DESC LIMIT 1)
SELECT (SELECT count(*) > 0 FROM ok) passed, (SELECT coalesce(string_agg(policy, ',' ORDER BY o), '') FROM (SELECT DISTINCT policy, o FROM ok)) passing_policies, (SELECT policy FROM b) policy, (SELECT threshold FROM b) threshold, (SELECT round("precision", 6) FROM b) "precision", (SELECT round(recall, 6) FROM b) recall""")
def gate_verdict(spark, sf):
    """The provisional verdict: rows of both floors that flag the target clip; of these the largest (recall, precision, policy, threshold)."""
    policies = list(A.policies("probs", [3], [0]))
    target = scores(spark, sf).filter(F.col("clip") == TARGET).groupBy("policy").agg(F.max("s").alias("target"))
    ok = curve(spark, sf).join(target, "policy").filter((F.col("precision") >= FLOORS[0]) & (F.col("recall") >= FLOORS[1]) & (F.col("target") >= F.col("threshold")))
    g = ok.agg(F.count("*").alias("n"), F.collect_set("policy").alias("ps"), F.max(F.struct("recall", "precision", "policy", "threshold")).alias("b"))
    named = F.array_join(F.filter(F.lit(policies), lambda x: F.array_contains("ps", x)), ",")  # in the order of the curves
    return round_doubles(g.select((F.col("n") > 0).alias("passed"), named.alias("passing_policies"), "b.policy", "b.threshold", "b.precision", "b.recall"))


# text -------------------------------------------------------------------------------------------------


@query("normalize_en", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(lower(text), '''', ''), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents WHERE lang = 'en'")
def normalize_en(spark, sf):
    return table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", F.md5(X.normalize_en("text").cast("binary")).alias("digest"))


S.SQL["v_kana"] = "SELECT doc_id, translate(lower(text), 'aeiouknst.,', 'アえイおうかンさタ。、') AS text FROM documents"


def kana(spark, sf):
    """Letters of the documents as mixed kana."""
    return table(spark, sf, "documents").select("doc_id", F.translate(F.lower("text"), "aeiouknst.,", "アえイおうかンさタ。、").alias("text"))


@query("normalize_ja", r"SELECT doc_id, md5(regexp_replace(translate(text, '。、．，！？・「」『』（）', ''), '\s+', '', 'g')) AS digest FROM v_kana")
def normalize_ja(spark, sf):
    return kana(spark, sf).select("doc_id", F.md5(X.normalize_ja("text").cast("binary")).alias("digest"))


@query("normalize_generic", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '\p{P}', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents WHERE lang <> 'en'")
def normalize_generic(spark, sf):
    return table(spark, sf, "documents").filter("lang != 'en'").select("doc_id", F.md5(X.normalize_generic("text").cast("binary")).alias("digest"))


@query("normalize_compare", r"SELECT doc_id, md5(translate(regexp_replace(text, '\s+', '', 'g'), '、。,.!?！？…・「」『』()（）', '')) AS digest FROM documents")
def normalize_compare(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalize_compare("text", width=False).cast("binary")).alias("digest"))


def _kana_sql() -> str:
    """Twin of alignment_text on text that compatibility composition leaves as it is."""
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    hira = "".join(chr(ord(k) - 0x60) for k in kata)
    cjk = "[぀-ヿ一-鿿]"
    d = "n[length(n) - q]"
    digit = f"CASE WHEN {d} = '0' THEN '' ELSE CASE WHEN {d} = '1' AND q % 4 > 0 THEN '' ELSE ('〇一二三四五六七八九')[CAST({d} AS INT) + 1] END || (['', '十', '百', '千'])[q % 4 + 1] END"
    group = "CASE WHEN q % 4 = 0 AND trim(n[greatest(length(n) - q - 3, 1):length(n) - q], '0') <> '' THEN (['', '万', '億', '兆', '京'])[q // 4 + 1] ELSE '' END"
    number = f"CASE WHEN n = '' THEN '零' WHEN length(n) > 20 THEN part ELSE array_to_string([{digit} || {group} FOR q IN generate_series(length(n) - 1, 0, -1)], '') END"
    marks = X.ALIGN_MARKS.replace("'", "''")
    return rf"""
WITH p AS (SELECT doc_id, i, ps[i] part, ltrim(ps[i], '0') n, regexp_matches(ps[i], '^[0-9]') AND (regexp_matches(coalesce(ps[i - 1], ''), '{cjk}$') OR regexp_matches(coalesce(ps[i + 1], ''), '^{cjk}')) AS by_cjk
 FROM (SELECT doc_id, ps, unnest(generate_series(1, len(ps))) i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+|[^0-9]+') ps FROM v_kana))),
t AS (SELECT doc_id, string_agg(CASE WHEN by_cjk THEN {number} ELSE part END, '' ORDER BY i) AS text FROM p GROUP BY doc_id)
SELECT k.doc_id, md5(regexp_replace(translate(translate(coalesce(t.text, ''), '{kata}', '{hira}'), '{marks}', ''), '\s+', '', 'g')) AS digest FROM v_kana k LEFT JOIN t USING (doc_id) WHERE k.text IS NOT NULL"""


@query("kana_alignment_text", _kana_sql())
def kana_alignment_text(spark, sf):
    text = X.alignment_text("text").cast("binary")
    return kana(spark, sf).filter("text is not null").select("doc_id", F.md5(text).alias("digest"))


SANDWICH = "([ァ-ヴー][ぁ-ゖ][ァ-ヴー])|([ぁ-ゖ][ァ-ヴー][ぁ-ゖ])"


@query("script_mix_count", f"WITH x AS (SELECT doc_id, regexp_extract(text, '{SANDWICH}') found FROM v_kana WHERE regexp_matches(text, '{SANDWICH}')) SELECT count(*) clips, (SELECT string_agg(doc_id || ':' || found, ',' ORDER BY doc_id) FROM (SELECT * FROM x ORDER BY doc_id LIMIT 20)) examples FROM x")
def script_mix_count(spark, sf):
    """Texts with a one-character sandwich of scripts, and the first 20 of them with what was found."""
    x = kana(spark, sf).filter(F.col("text").rlike(SANDWICH)).select("doc_id", F.regexp_extract("text", SANDWICH, 0).alias("found"))
    return C.with_examples(x, x.agg(F.count("*").alias("clips")), ["doc_id"], [F.col("doc_id").cast("string"), F.col("found")], 20)


S.SQL["v_coded"] = """SELECT doc_id, piece, lang, ref, hyp, r, h, list_distinct(list_concat(r, h)) k FROM (SELECT *, string_split(ref, ' ') r, string_split(hyp, ' ') h FROM v_pairs)"""
WER = "levenshtein(array_to_string([chr((40 + list_position(k, x))::INT) FOR x IN r], ''), array_to_string([chr((40 + list_position(k, x))::INT) FOR x IN h], ''))"


@query("wer", f"SELECT doc_id, piece, round({WER} / len(r), 6) wer FROM v_coded")
def wer(spark, sf):
    return S.pairs(spark, sf).select("doc_id", "piece", r6(X.wer("ref", "hyp"), "wer"))


@query("cer", "SELECT doc_id, piece, round(levenshtein(ref, hyp) / length(ref), 6) cer FROM v_pairs")
def cer(spark, sf):
    return S.pairs(spark, sf).select("doc_id", "piece", r6(X.cer("ref", "hyp"), "cer"))


@query("udaf_edit_rate", f"SELECT lang, round(avg(e / n), 6) mean_wer, round(sum(e) / sum(n), 6) micro_wer FROM (SELECT lang, {WER} e, len(r) n FROM v_coded) GROUP BY lang")
def udaf_edit_rate(spark, sf):
    p = S.pairs(spark, sf).select("lang", X.edits(X.word_list(F.col("ref")), X.word_list(F.col("hyp"))).alias("e"), F.size(X.word_list(F.col("ref"))).alias("n"))
    return round_doubles(p.groupBy("lang").agg(F.avg(F.col("e") / F.col("n")).alias("mean_wer"), (F.sum("e") / F.sum("n")).alias("micro_wer")))


@query("truncation_side", "SELECT doc_id, piece, CASE WHEN doc_id % 4 = 1 AND length(ref) - length(ref[1:20]) >= 2 THEN 'b' WHEN doc_id % 4 = 2 AND length(ref) - length(ref[1:20]) >= 2 THEN 'a' END side FROM v_pairs")
def truncation_side(spark, sf):
    m, cut = F.col("doc_id") % 4, F.substring("ref", 1, 20)
    a, b = F.when(m == 2, cut).otherwise(F.col("ref")), F.when(m == 1, cut).when(m == 3, F.concat(F.lit("x"), cut)).otherwise(F.col("ref"))
    return S.pairs(spark, sf).select("doc_id", "piece", X.truncated_side(a, b).alias("side"))


S.SQL["v_agree"] = """SELECT *, CASE WHEN a <> b AND starts_with(b, a) AND length(b) - length(a) >= 2 THEN 'a' WHEN a <> b AND starts_with(a, b) AND length(a) - length(b) >= 2 THEN 'b' END side
FROM (SELECT doc_id, piece, ref b, CASE WHEN doc_id % 4 = 0 THEN left(ref, greatest(length(ref) - 3, 0)) WHEN doc_id % 4 = 1 THEN ref || ' more' WHEN doc_id % 4 = 2 THEN hyp ELSE ref END a FROM v_pairs)"""


@query("text_agreement", """
SELECT count(*) pairs, round(count_if(a = b) / count(*), 6) equal_rate, count_if(side = 'a') truncated_a, count_if(side = 'b') truncated_b, (SELECT string_agg(doc_id || ':' || piece || ':' || side || ':' || md5(a), ',' ORDER BY doc_id, piece) FROM (SELECT * FROM v_agree WHERE side IS NOT NULL ORDER BY doc_id, piece LIMIT 10)) examples FROM v_agree""")
def text_agreement(spark, sf):
    """How often two recognisers agree, how often one cuts its text short, and the first ten such pairs."""
    m, ref = F.col("doc_id") % 4, F.col("ref")
    a = F.when(m == 0, F.substring(ref, F.lit(1), F.greatest(F.length(ref) - 3, F.lit(0)))).when(m == 1, F.concat(ref, F.lit(" more"))).when(m == 2, F.col("hyp")).otherwise(ref)
    p = S.pairs(spark, sf).select("doc_id", "piece", a.alias("a"), ref.alias("b"))
    p = p.withColumn("side", X.truncated_side("a", "b"))
    g = p.agg(F.count("*").alias("pairs"), (F.count_if(F.col("a") == F.col("b")) / F.count("*")).alias("equal_rate"), F.count_if(F.coalesce(F.col("side") == "a", F.lit(False))).alias("truncated_a"), F.count_if(F.coalesce(F.col("side") == "b", F.lit(False))).alias("truncated_b"))
    return C.with_examples(p.filter("side is not null"), round_doubles(g), ["doc_id", "piece"], [F.col("doc_id").cast("string"), F.col("piece").cast("string"), F.col("side"), F.md5(F.col("a").cast("binary"))], 10)


SHORT = r"CASE WHEN trim(text) = '' THEN false WHEN regexp_matches(trim(text), '[。！？.!?]$') THEN false WHEN regexp_matches(trim(text), '\s') THEN false ELSE length(trim(text)) <= 4 END"


@query("is_short_utterance", f"SELECT source_id, turn, {SHORT} short FROM v_utt")
def is_short_utterance(spark, sf):
    return S.utterances(spark, sf).select("source_id", "turn", X.is_short("text").alias("short"))


S.SQL["v_next"] = "SELECT source_id, turn, text a, lead(text) OVER (PARTITION BY source_id ORDER BY turn) b, language FROM v_utt"


@query("join_text", "SELECT source_id, turn, CASE WHEN language = 'en' OR (language IS NULL AND (contains(a, ' ') OR contains(b, ' '))) THEN a || ' ' || b ELSE a || b END AS text FROM v_next WHERE b IS NOT NULL")
def join_text(spark, sf):
    u = S.utterances(spark, sf).withColumn("b", F.lead("text").over(W.partitionBy("source_id").orderBy("turn"))).filter("b is not null")
    return u.select("source_id", "turn", X.join_text("text", "b", F.col("language")).alias("text"))


STAMP = "printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)"


@query("srt_timestamp", f"SELECT event_id, (SELECT {STAMP} FROM (SELECT CAST(round_even(value * 100 * 1000, 0) AS BIGINT) ms)) rounded, (SELECT {STAMP} FROM (SELECT CAST(floor(greatest(value - 50, 0) * 1000) AS BIGINT) ms)) truncated FROM events")
def srt_timestamp(spark, sf):
    return table(spark, sf, "events").select("event_id", X.stamp(F.col("value") * 100).alias("rounded"), X.stamp(F.col("value") - 50, truncate=True).alias("truncated"))


@query("language_code", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'zh-TW' WHEN doc_id % 3 = 0 THEN 'zh-CN' ELSE lang END google, CASE WHEN doc_id % 5 = 0 THEN 'zh' WHEN doc_id % 3 = 0 THEN 'zh' ELSE lang END iso, 'Helsinki-NLP/opus-mt-' || CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'zh' ELSE lang END || '-en' AS model FROM documents")
def language_code(spark, sf):
    m = F.col("doc_id")
    code = F.when(m % 5 == 0, "zh-TW").when(m % 3 == 0, "ZH_cn").otherwise(F.concat("lang", F.lit("-XX")))
    iso = X.primary_language(code)
    traditional = F.lower(code).isin("zh-tw", "zh-hant")
    google = F.when(traditional, "zh-TW").when(iso == "zh", "zh-CN").otherwise(iso)
    return table(spark, sf, "documents").select("doc_id", google.alias("google"), iso.alias("iso"), F.concat(F.lit("Helsinki-NLP/opus-mt-"), iso, F.lit("-en")).alias("model"))


@query("extract_last_sentence", r"""
SELECT conv_id, turn, CASE WHEN contains(t, chr(10)) THEN trim(string_split(t, chr(10))[-1]) WHEN len(parts) > 1 THEN trim(parts[-1]) ELSE t END last FROM (SELECT conv_id, turn, t, list_filter(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') parts FROM (SELECT conv_id, turn, trim(text) t FROM conversations))""")
def extract_last_sentence(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.last_sentence("text", 1).alias("last"))


# signals ----------------------------------------------------------------------------------------------

SQ = "list_sum([x * x FOR x IN {}])"
WHOLE = "sqrt(list_sum([x * x FOR x IN samples]) / 64)"
FRAME = "[sqrt(list_sum([x * x FOR x IN samples[i * 8 + 1:i * 8 + 8]]) / 8) FOR i IN range(8)]"


@query("frame_energy", f"""
SELECT clip, round(20 * log10({WHOLE}), 6) whole, round(20 * log10(list_max(f)), 6) max_frame, round(20 * log10(list_aggregate(f, 'quantile_cont', 0.95)), 6) p95_frame, round(20 * log10(list_avg(list_reverse_sort(f)[1:3])), 6) top3_frame FROM (SELECT *, {FRAME} f FROM v_audio)""")
def frame_energy(spark, sf):
    return S.audio(spark, sf).select("clip", *(r6(A.energy_dbfs("samples", 8, m), n) for m, n in zip(A.ENERGY_METRICS, ("whole", "max_frame", "p95_frame", "top3_frame"), strict=True)))


@query("level_db", f"SELECT clip, round(20 * log10(greatest({WHOLE}, 1e-10)), 6) rms_db, round(20 * log10(greatest(list_max([abs(x) FOR x IN samples]), 1e-10)), 6) peak_db FROM v_audio")
def level_db(spark, sf):
    return S.audio(spark, sf).select("clip", r6(A.db(A.rms("samples")), "rms_db"), r6(A.db(A.peak("samples")), "peak_db"))


@query("zero_crossing_rate", "SELECT clip, round(list_sum([CASE WHEN (samples[i] < 0) <> (samples[i + 1] < 0) THEN 1 ELSE 0 END FOR i IN range(1, 64)]) / 63, 6) zcr FROM v_audio")
def zero_crossing_rate(spark, sf):
    return S.audio(spark, sf).select("clip", r6(A.zero_crossing_rate("samples"), "zcr"))


@query("spectral_shape", "SELECT clip, round(exp(list_avg([ln(greatest(x * x, 1e-12)) FOR x IN samples])) / list_avg([greatest(x * x, 1e-12) FOR x IN samples]), 6) flatness, round(list_sum([abs(samples[i]) * (i - 1) * 125 FOR i IN generate_series(1, 64)]) / list_sum([abs(x) FOR x IN samples]), 6) centroid_hz FROM v_audio")
def spectral_shape(spark, sf):
    s = F.transform("samples", F.abs)
    return S.audio(spark, sf).select("clip", r6(A.flatness(F.transform(s, lambda x: x * x)), "flatness"), r6(A.centroid(s, 125.0), "centroid_hz"))


@query("voiced_confidence", """
SELECT clip, round(greatest(list_max([list_sum([c[i] * c[i + k] FOR i IN generate_series(1, 64 - k)]) FOR k IN generate_series(2, 12)]) / list_sum([x * x FOR x IN c]), 0), 6) voiced FROM (SELECT clip, [x - m FOR x IN samples] c FROM (SELECT clip, samples, list_avg(samples) m FROM v_audio))""")
def voiced_confidence(spark, sf):
    return S.audio(spark, sf).select("clip", r6(A.voiced_confidence("samples", 2, 12), "voiced"))


S.SQL["v_mixin"] = "SELECT a.clip, a.samples s, b.samples[1:40] n, (a.clip % 5) * 5.0::DOUBLE snr FROM v_audio a JOIN v_audio b ON b.clip = (a.clip * 7 + 1) % (SELECT count(*) FROM v_audio)"
S.SQL["v_mixed"] = f"""
SELECT clip, snr, s, f, [s[i] + g * f[i] FOR i IN generate_series(1, 64)] mixed FROM (SELECT *, sqrt({SQ.format('s')} / ({SQ.format('f')} * power(10, snr / 10))) g FROM (SELECT *, [n[(i - 1) % 40 + 1] FOR i IN generate_series(1, 64)] f FROM v_mixin))"""


def mixed(spark, sf):
    a = S.audio(spark, sf)
    n = a.count()
    b = a.select(F.col("clip").alias("other"), F.slice("samples", 1, 40).alias("noise"))
    j = a.withColumn("other", (F.col("clip") * 7 + 1) % n).join(b, "other").withColumn("snr", (F.col("clip") % 5) * 5.0)
    return j.withColumn("mixed", A.mix_at_snr("samples", "noise", F.col("snr")))


@query("mix_at_snr", "SELECT clip, snr, round(list_sum([abs(x) FOR x IN mixed]), 6) loudness, round(mixed[64], 6) + 0.0 AS last FROM v_mixed")
def mix_at_snr(spark, sf):
    return mixed(spark, sf).select("clip", "snr", r6(A.total("mixed", F.abs), "loudness"), r6(F.element_at("mixed", 64), "last"))


@query("peak_renorm", f"""
SELECT clip, pk > 1 clipped, round(CASE WHEN pk > 1 THEN 0.95 ELSE pk END, 6) peak, round(10 * log10({SQ.format('s')} / {SQ.format('d')}), 6) achieved_snr FROM (SELECT *, list_max([abs(x * 3) FOR x IN mixed]) pk, [mixed[i] - s[i] FOR i IN generate_series(1, 64)] d FROM v_mixed)""")
def peak_renorm(spark, sf):
    m = mixed(spark, sf).withColumn("r", A.renorm(F.transform("mixed", lambda x: x * 3)))
    noise = F.zip_with("mixed", "samples", lambda x, y: x - y)
    return m.select("clip", F.col("r.clipped").alias("clipped"), r6(A.peak("r.samples"), "peak"), r6(10 * F.log10(A.power("samples") / A.power(noise)), "achieved_snr"))


@query("chunk_array", """
SELECT clip, j AS chunk, round(samples[CAST(round_even(j * (64 - 10) / 4, 0) AS INT) + 1], 6) + 0.0 AS first, 10 AS n FROM (SELECT clip, samples, unnest(range(5)) j FROM v_audio)""")
def chunk_array(spark, sf):
    c = S.audio(spark, sf).select("clip", F.posexplode(A.uniform_windows("samples", 10, 5)).alias("chunk", "w"))
    return c.select("clip", "chunk", r6(F.get("w", F.lit(0)), "first"), F.size("w").alias("n"))


@query("fixed_sample_windows", "SELECT clip, k place, round(list_sum([coalesce(samples[k * 10 + j], 0) FOR j IN generate_series(1, 10)]), 6) + 0.0 total, 10 AS n FROM (SELECT clip, samples, unnest(range(7)) k FROM v_audio)")
def fixed_sample_windows(spark, sf):
    """Windows of ten samples one after the other, the last one padded with zeros."""
    w = S.audio(spark, sf).select("clip", F.posexplode(A.padded_windows("samples", 10)).alias("place", "w"))
    return w.select("clip", "place", r6(A.total("w"), "total"), F.size("w").alias("n"))


@query("overlapping_sample_frames", "SELECT clip, k frame, round(list_sum(samples[k * 8 + 1:k * 8 + 16]), 6) + 0.0 total FROM (SELECT clip, samples, unnest(range(7)) k FROM v_audio)")
def overlapping_sample_frames(spark, sf):
    """Whole frames of 16 samples every 8: half overlapped, as 32 ms every 16 ms are."""
    w = S.audio(spark, sf).select("clip", F.posexplode(A.overlapping_frames("samples", 16, 8)).alias("frame", "w"))
    return w.select("clip", "frame", r6(A.total("w"), "total"))


@query("mixed_manifest_row", """
SELECT m.doc_id, m.vec_id, 'doc' || m.doc_id || '_snr' || CASE WHEN snr = floor(snr) THEN CAST(snr::INT AS VARCHAR) ELSE printf('%.1f', snr) END || '_c' || e.label || '.wav' AS path, 'noisy_speech' AS label, snr::DOUBLE snr_db, md5(d.text) reference_md5, 'c' || e.label subtype FROM v_mixpairs m JOIN documents d USING (doc_id) JOIN embeddings e USING (vec_id)""")
def mixed_manifest_row(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("reference_md5"))
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("subtype"))
    snr = F.col("snr")
    shown = F.when(snr == F.floor(snr), snr.cast("long").cast("string")).otherwise(F.format_string("%.1f", snr))
    path = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_snr"), shown, F.lit("_"), F.col("subtype"), F.lit(".wav"))
    return mix_pairs(spark, sf).join(d, "doc_id").join(e, "vec_id").select("doc_id", "vec_id", path.alias("path"), F.lit("noisy_speech").alias("label"), snr.alias("snr_db"), "reference_md5", "subtype")
