"""Queries of stateful and streaming operators, and of the model hooks."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.operators import hooks as H
from cadenza.operators import segments as G
from cadenza.operators.windows import numbered_within
from cadenza.plans import suite as S
from cadenza.plans.columns import context_of
from cadenza.plans.suite import query, r6, round_doubles, table
from cadenza.runtime import scratch_path
from cadenza.streaming import jobs as J

#: Micro-batches over which a query's stream comes.
BATCHES = 20

CONFIG = G.VadConfig(min_speech_ms=96, min_silence_ms=96, speech_pad_ms=160, max_speech_ms=960)

# mode 0 silence, 1 potential, 2 speech, 3 ending; fin: a segment (start, ts) ends with this row
def machine_sql(loud: int, quiet: int, pad: int, held: int | None = None, interim: tuple[int, int] | None = None) -> str:
    """Recursive SQL of the state machine with its counts in frames; held is the longest segment, interim the least new frames and milliseconds of a provisional row."""
    over = f"was = 2 AND held * 32 >= {held * 32}" if held else "false"
    tell = f"was = 2 AND NOT fin AND (held - told) * 32 >= {interim[0] * 32} AND (ts - told_at) * 1000 >= {interim[1]}" if interim else "false"
    keep = lambda c, none: f"CASE WHEN fin OR dead THEN {none} ELSE {c} END"
    return f"""
f AS (SELECT source_id, frame_idx, p >= 0.5 sp, ts_s, frame_idx = max(frame_idx) OVER (PARTITION BY source_id) last FROM v_frames),
m(source_id, i, mode, pre, loud, quiet, start, held, told_at, told, fin, tells, fin_start, ts, last) AS (
 SELECT DISTINCT source_id, -1::BIGINT, 0, 0, 0, 0, 0.0::DOUBLE, 0, 0.0::DOUBLE, 0, false, false, 0.0::DOUBLE, 0.0::DOUBLE, false FROM f
 UNION ALL
 SELECT source_id, i, {keep('mode', 0)}, {keep('pre', 0)}, {keep('loud', 0)}, {keep('quiet', 0)}, {keep('start', 0)}, {keep('held', 0)}, {keep('CASE WHEN tells THEN ts ELSE told_at END', 0)}, {keep('CASE WHEN tells THEN held ELSE told END', 0)}, fin, tells, start, ts, last FROM (
  SELECT *, {tell} tells FROM (SELECT *, (was = 3 AND NOT sp AND quiet >= {pad}) OR ({over}) fin, was = 1 AND NOT sp AND quiet >= {quiet} dead FROM (
   SELECT f.source_id, f.frame_idx i, m.mode was, f.sp, f.ts_s ts, f.last, m.told_at, m.told, CASE WHEN m.mode = 0 THEN least(m.pre + 1, {pad}) ELSE m.pre END pre,
    CASE WHEN m.mode = 0 THEN CASE WHEN f.sp THEN 1 ELSE 0 END WHEN m.mode = 1 THEN CASE WHEN f.sp AND m.loud + 1 >= {loud} THEN 2 ELSE 1 END WHEN m.mode = 2 THEN CASE WHEN NOT f.sp AND m.quiet + 1 >= {quiet} THEN 3 ELSE 2 END ELSE CASE WHEN f.sp THEN 2 ELSE 3 END END mode,
    CASE WHEN m.mode = 0 THEN CASE WHEN f.sp THEN 1 ELSE 0 END WHEN m.mode = 1 AND f.sp THEN m.loud + 1 ELSE m.loud END loud, CASE WHEN m.mode = 0 OR f.sp THEN 0 ELSE m.quiet + 1 END quiet,
    CASE WHEN m.mode = 0 THEN CASE WHEN f.sp THEN greatest(0, f.ts_s - least(m.pre + 1, {pad}) * 0.032::DOUBLE) ELSE 0 END ELSE m.start END start, CASE WHEN m.mode = 0 THEN CASE WHEN f.sp THEN least(m.pre + 1, {pad}) + 1 ELSE 0 END ELSE m.held + 1 END held
   FROM m JOIN f ON f.source_id = m.source_id AND f.frame_idx = m.i + 1))))
"""


VAD_SQL = machine_sql(3, 3, 5, 30)


@query("vad_segments", f"WITH {VAD_SQL} SELECT source_id, round(fin_start, 6) start_time, round(ts, 6) end_time, true AS is_final FROM m WHERE fin UNION ALL SELECT source_id, round(start, 6), round(ts, 6), true FROM m WHERE last AND NOT fin AND mode > 0")
def vad_segments(spark, sf):
    return round_doubles(G.vad_segments(S.frames(spark, sf), CONFIG))


def scattered_frames(spark, sf):
    """Frames as a stream in which every source's rows are spread over all micro-batches, in no order."""
    f = S.frames(spark, sf).select("source_id", "frame_idx", "ts_s", "p")
    return J.stream_of(spark, f, "frames", BATCHES, ["source_id", "frame_idx"])


@query("vad_segments_stream", f"WITH {VAD_SQL} SELECT source_id, round(fin_start, 6) start_time, round(ts, 6) end_time, true AS is_final FROM m WHERE fin")
def vad_segments_stream(spark, sf):
    """The same machine on a stream; a source that may go on has no forced end."""
    return round_doubles(J.run_available(J.vad_stream(scattered_frames(spark, sf), CONFIG), "segments"))


INTERIM = G.VadConfig(min_speech_ms=96, min_silence_ms=320, speech_pad_ms=320, interim_min_ms=160, interim_interval_ms=160)


@query("interim_updates", f"WITH {machine_sql(3, 10, 10, None, (5, 160))} SELECT source_id, round(fin_start, 6) start_time, round(ts, 6) end_time, false AS is_final FROM m WHERE tells")
def interim_updates(spark, sf):
    """Provisional rows of a stream, whose frames wait until those before them have come."""
    return round_doubles(J.run_available(J.vad_stream(scattered_frames(spark, sf), INTERIM, interim=True), "interim")).filter("not is_final")


#: Seconds; utterances start three seconds apart, so short ones merge within it.
WINDOW_S = 3.0


def coalesce_sql(view: str, waits: str = "true", window: float = WINDOW_S) -> str:
    """Recursive SQL of the push rule over a view of utterances; rows of e are emitted. waits: whether m.h still waits when u comes."""
    near = f"(u.start_time - m.h.e <= {window} AND {waits})"
    short = r"(trim({0}) <> '' AND NOT regexp_matches(trim({0}), '[。！？.!?]$') AND NOT regexp_matches(trim({0}), '\s') AND length(trim({0})) <= 4)"
    return f"""
u AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY turn) i FROM {view}),
m(source_id, i, n, h, e) AS (
 SELECT DISTINCT source_id, 0::BIGINT, (SELECT max(i) FROM u x WHERE x.source_id = u.source_id), NULL::STRUCT(t VARCHAR, s DOUBLE, e DOUBLE, c DOUBLE, l VARCHAR, k INT), []::STRUCT(t VARCHAR, s DOUBLE, e DOUBLE, c DOUBLE, l VARCHAR, k INT)[] FROM u
 UNION ALL
 SELECT source_id, i, n, CASE WHEN {short.format('w.t')} THEN w END, list_concat(out, CASE WHEN {short.format('w.t')} THEN [] ELSE [w] END) FROM (
  SELECT u.source_id, u.i, m.n, CASE WHEN m.h IS NOT NULL AND NOT {near} THEN [m.h] ELSE [] END out,
   CASE WHEN m.h IS NOT NULL AND {near} THEN struct_pack(t := CASE WHEN coalesce(m.h.l, u.language) = 'en' OR (coalesce(m.h.l, u.language) IS NULL AND (contains(m.h.t, ' ') OR contains(u.text, ' '))) THEN m.h.t || ' ' || u.text ELSE m.h.t || u.text END, s := m.h.s, e := u.end_time, c := least(m.h.c, u.confidence), l := coalesce(m.h.l, u.language), k := (m.h.k + 1)::INT)
   ELSE struct_pack(t := u.text, s := u.start_time, e := u.end_time, c := u.confidence, l := u.language, k := 1::INT) END w
  FROM m JOIN u ON u.source_id = m.source_id AND u.i = m.i + 1)),
done AS (SELECT source_id, unnest(e) w FROM m UNION ALL SELECT source_id, h FROM m WHERE i = n AND h IS NOT NULL)
"""


@query("utterance_coalesce", f"WITH {coalesce_sql('v_utt')} SELECT source_id, w.t AS text, round(w.s, 6) start_time, round(w.e, 6) end_time, round(w.c, 6) confidence, w.l AS language, w.k merged FROM done")
def utterance_coalesce(spark, sf):
    out = G.coalesce_utterances(S.utterances(spark, sf), WINDOW_S)
    return round_doubles(out.withColumn("language", F.nullif("language", F.lit(""))))


#: Chunks of half a second: many short utterances time out before the next one ends.
CHUNK_S = 0.5
MERGED = "source_id, w.t AS text, round(w.s, 6) start_time, round(w.e, 6) end_time, round(w.c, 6) confidence, w.l AS language, w.k merged"


@query("utterance_coalesce_clocked", f"WITH {coalesce_sql('v_utt', f'(ceil(u.end_time / {CHUNK_S}::DOUBLE) - 1) * {CHUNK_S}::DOUBLE < m.h.e + {WINDOW_S}')} SELECT {MERGED} FROM done")
def utterance_coalesce_clocked(spark, sf):
    """The coalescer as it runs live: chunks of half a second, each of which ends by releasing what has waited for the window."""
    out = G.coalesce_utterances(S.utterances(spark, sf), WINDOW_S, chunk=CHUNK_S)
    return round_doubles(out.withColumn("language", F.nullif("language", F.lit(""))))


#: The stream's clock stands a millisecond after the start of an utterance, and the watermark so far behind the newest.
DELAY_MS, CELL_MS = 90_000, 60_000
S.SQL["v_clock"] = f"SELECT *, floor(start_time * 1000)::BIGINT + 1 ms, max(floor(start_time * 1000)::BIGINT + 1) OVER () - {DELAY_MS} mark FROM v_utt"
S.SQL["v_seen"] = f"SELECT * FROM v_clock WHERE (ms // {CELL_MS} + 1) * {CELL_MS} <= mark"


@query("coalesce_timeout", f"""
WITH {coalesce_sql('v_seen')}, told AS (SELECT source_id, unnest(e) w FROM m UNION ALL SELECT source_id, h FROM m WHERE i = n AND h IS NOT NULL AND ceil(h.e * 1000) + {int(WINDOW_S * 1000)} + 1 <= (SELECT max(mark) FROM v_clock)
 AND NOT EXISTS (SELECT 1 FROM v_clock c WHERE c.source_id = m.source_id AND (c.ms // {CELL_MS} + 1) * {CELL_MS} > c.mark AND c.ms // {CELL_MS} * {CELL_MS} <= ceil(h.e * 1000) + {int(WINDOW_S * 1000)}))
SELECT source_id, w.t AS text, round(w.s, 6) start_time, round(w.e, 6) end_time, round(w.c, 6) confidence, w.l AS language, w.k merged FROM told""")
def coalesce_timeout(spark, sf):
    """The streaming coalescer over utterances that come up to a minute out of order: what is held leaves when the event clock passes its end and the window."""
    ms = F.floor(F.col("start_time") * 1000) + 1
    u = S.utterances(spark, sf).withColumn("ts", F.timestamp_millis(ms)).select("source_id", "turn", *G.UTTERANCE, "ts")
    part = F.col("start_time") % 300_000 + F.pmod(F.xxhash64("source_id", "turn"), F.lit(60))
    batch = F.floor(F.col("start_time") / 300_000) * 3 + F.least(F.floor(part / 100), F.lit(2))
    batches = u.agg(F.max(F.floor(F.col("start_time") / 300_000))).first()[0]
    s = J.slices_of(spark, u, "utterances", batch, 3 * (int(batches or 0) + 1))
    s = s.withWatermark("ts", f"{DELAY_MS} milliseconds")
    return round_doubles(J.run_available(J.coalesce_stream(s, WINDOW_S, CELL_MS), "coalesced"))


S.SQL["v_kept"] = "SELECT * FROM v_utt WHERE confidence >= 0.2 AND text <> ''"


@query("settled_events", f"""
WITH {coalesce_sql('v_kept')} SELECT source_id, true AS emitted, NULL AS reason, round(w.s, 6) start_time, round(w.e, 6) end_time FROM done
UNION ALL SELECT source_id, false, CASE WHEN text = '' THEN 'engine_empty' ELSE 'filter_reject' END, round(start_time, 6), round(end_time, 6) FROM v_utt WHERE NOT (confidence >= 0.2 AND text <> '')""")
def settled_events(spark, sf):
    """One row per logical utterance: emitted ones after merging, and drops with their reason."""
    u = S.utterances(spark, sf).withColumn("reason", F.when(F.col("text") == "", "engine_empty").when(F.col("confidence") < 0.2, "filter_reject"))
    done = G.coalesce_utterances(u.filter("reason is null"), WINDOW_S)
    rows = lambda d, e, r: d.select("source_id", F.lit(e).alias("emitted"), r.alias("reason"), "start_time", "end_time")
    return round_doubles(rows(done, True, F.lit(None).cast("string")).union(rows(u.filter("reason is not null"), False, F.col("reason"))))


GATE = G.GateConfig(open_level=60.0, close_level=40.0, attack=2, release=3, floor=0.1)


@query("hysteresis_gate", """
WITH m(source_id, i, env, op, hold, x) AS (
 SELECT DISTINCT source_id, -1::BIGINT, 0.0::DOUBLE, false, 0, 0.0::DOUBLE FROM v_frames
 UNION ALL
 SELECT source_id, i, env, CASE WHEN op THEN env > 40 OR hold > 0 ELSE env > 60 END, CASE WHEN op THEN CASE WHEN env > 40 THEN 3 WHEN hold > 0 THEN hold - 1 ELSE 0 END ELSE CASE WHEN env > 60 THEN 3 ELSE hold END END, x FROM (
  SELECT f.source_id, f.frame_idx i, f.value x, m.op, m.hold, CASE WHEN abs(f.value) > m.env THEN m.env + (1 - exp(-1 / 2)) * (abs(f.value) - m.env) ELSE m.env * exp(-1 / 3) END env FROM m JOIN v_frames f ON f.source_id = m.source_id AND f.frame_idx = m.i + 1))
SELECT source_id, i frame_idx, op AS open, round(CASE WHEN op THEN x ELSE x * 0.1 END, 6) gated FROM m WHERE i >= 0""")
def hysteresis_gate(spark, sf):
    g = G.hysteresis_gate(S.frames(spark, sf).select("source_id", "frame_idx", "value"), GATE)
    return g.select("source_id", "frame_idx", "open", r6("gated"))


SIZE = 50
S.SQL["v_stream"] = f"SELECT label source_id, pos // {SIZE} frame_idx, x FROM (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY clip, k) - 1 pos FROM (SELECT label, clip, unnest(samples) x, unnest(range(64)) k FROM v_audio))"


@query("frame_stream", f"SELECT source_id, frame_idx, round(sum(x), 6) + 0.0 total FROM v_stream GROUP BY ALL HAVING count(*) = {SIZE}")
def frame_stream(spark, sf):
    """A label's clips are the chunks of one source, numbered; they come in no order."""
    a = numbered_within(S.audio(spark, sf).select(F.col("label").cast("long").alias("source_id"), "clip", "samples"), ["source_id"], ["clip"], "seq")
    chunks = J.stream_of(spark, a.select("source_id", "seq", "samples"), "chunks", BATCHES, ["source_id", "seq"])
    out = J.run_available(J.frame_stream(chunks, SIZE), "frames")
    return out.select("source_id", "frame_idx", r6(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), "total"))


@query("fixed_windows", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) n, round(avg(value), 6) mean FROM events GROUP BY ALL")
def fixed_windows(spark, sf):
    g = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return round_doubles(g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "mean"))


@query("overlapping_frames", """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) n, round(sum(value), 6) total FROM (SELECT value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) s FROM events) GROUP BY s""")
def overlapping_frames(spark, sf):
    g = table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return round_doubles(g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total"))


@query("fixed_split", "SELECT doc_id, s // 1000 piece, length(text[s + 1:s + 1000]) n, md5(text[s + 1:s + 1000]) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) s FROM documents)")
def fixed_split(spark, sf):
    d = table(spark, sf, "documents").filter("text != ''")
    d = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(1000))).alias("s"))
    p = F.substring(F.col("text"), F.col("s") + 1, F.lit(1000))
    return d.select("doc_id", F.floor(F.col("s") / 1000).alias("piece"), F.length(p).cast("long").alias("n"), F.md5(p.cast("binary")).alias("digest"))


@query("session_segments", """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END nw FROM events WHERE value >= 50)) GROUP BY user_id, g""")
def session_segments(spark, sf):
    e = table(spark, sf, "events").filter("value >= 50").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


LATE_BATCHES = 12
S.SQL["v_slices"] = f"""SELECT event_id, ts, least({LATE_BATCHES - 1}, (epoch_us(ts) - lo) * {LATE_BATCHES} // (hi - lo + 1) + CASE WHEN event_id % 40 = 7 THEN 1 + event_id % 5 ELSE 0 END) batch
FROM (SELECT *, min(epoch_us(ts)) OVER () lo, max(epoch_us(ts)) OVER () hi FROM events)"""
# in micro-batch b Spark drops what lies behind the watermark that batch b - 1 ran with, which the batches before that one have set
S.SQL["v_marks"] = f"SELECT b, (SELECT max(ts) FROM v_slices WHERE batch <= b - 2) - INTERVAL '2 hours' AS mark FROM (SELECT unnest(range({LATE_BATCHES})) b)"
S.SQL["v_late"] = "SELECT ts, coalesce(ts <= mark, false) late, max(ts) OVER () newest FROM v_slices JOIN v_marks ON batch = b"


@query("late_data", """
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) n, (SELECT count(*) FROM v_late WHERE late) dropped FROM (SELECT time_bucket(INTERVAL '1 hour', ts) start, newest FROM v_late WHERE NOT late) WHERE start + INTERVAL '1 hour' <= newest - INTERVAL '2 hours' GROUP BY ALL""")
def late_data(spark, sf):
    """Hourly counts of different events of a stream in which every fortieth comes one to five micro-batches late.

    Windows leave when the watermark passes them; events behind it are dropped one by one, and query progress counts them.
    """
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    at = F.floor((F.unix_micros("ts") - F.lit(lo)) * LATE_BATCHES / F.lit((hi or 0) - (lo or 0) + 1))
    late = F.when(F.col("event_id") % 40 == 7, 1 + F.col("event_id") % 5).otherwise(0)
    s = J.slices_of(spark, e, "events", F.least(at + late, F.lit(LATE_BATCHES - 1)), LATE_BATCHES).withWatermark("ts", "2 hours")
    g = s.dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    out, dropped, _ = J.run_counted(g.select(F.col("w.start").alias("start"), "n"), "late")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.lit(dropped).cast("long").alias("dropped"))


# hooks ----------------------------------------------------------------------------------------------


def loudness_scorer():
    """A stand-in scorer: the text names the sign of the sum; near-silent input fails."""

    def score(a, rate):
        if abs(a.sum()) < 0.05:
            raise ValueError("too quiet")
        return ("loud" if a.sum() > 0 else "soft"), float(abs(a).max())

    return score


@query("hook_scorer", "SELECT clip, CASE WHEN quiet THEN '' WHEN total > 0 THEN 'loud' ELSE 'soft' END AS text, CASE WHEN NOT quiet THEN round(peak, 6) END confidence, CASE WHEN quiet THEN 'ValueError' END AS error FROM (SELECT clip, list_sum(samples) total, abs(list_sum(samples)) < 0.05 quiet, list_max([abs(x) FOR x IN samples]) peak FROM v_audio)")
def hook_scorer(spark, sf):
    return round_doubles(H.with_scorer(S.audio(spark, sf).select("clip", "samples"), loudness_scorer, 64))


@query("hook_segmenter", "SELECT clip, h * 0.5::DOUBLE AS start, h * 0.5::DOUBLE + 0.5::DOUBLE AS end FROM v_audio, (SELECT unnest([0, 1]) h) WHERE samples[1] >= 0")
def hook_segmenter(spark, sf):
    halves = lambda a, rate: [] if a[0] < 0 else [(0.0, len(a) / rate / 2), (len(a) / rate / 2, len(a) / rate)]
    return H.with_segmenter(S.audio(spark, sf).select("clip", "samples"), halves, 64).drop("samples", "error")


@query("hook_segmenter_errors", "SELECT clip, CASE WHEN clip % 3 = 0 THEN 'ZeroDivisionError' WHEN clip % 3 = 1 THEN 'TypeError' END AS error, CASE WHEN clip % 3 = 2 THEN 0.0::DOUBLE END AS start FROM v_audio")
def hook_segmenter_errors(spark, sf):
    """A segmenter that fails for a third of the clips and returns no pairs for another."""
    def broken(a, rate):
        kind = int(a[-1]) % 3
        return [(0.0, 1 / (kind > 0))] if kind != 1 else [3.0]

    a = S.audio(spark, sf).select("clip", F.concat("samples", F.array(F.col("clip").cast("double"))).alias("samples"))
    return H.with_segmenter(a, broken, 64).select("clip", "error", "start")


@query("hook_preprocessor", "SELECT clip, CASE WHEN samples[1] > 0 THEN NULL WHEN samples[2] > 0 THEN 'length changed' WHEN samples[3] > 0 THEN 'type changed' WHEN samples[4] > 0 THEN 'TypeError' ELSE 'IndexError' END AS error, CASE WHEN samples[1] > 0 THEN round(list_max([least(greatest(x, -0.1), 0.1) FOR x IN samples]), 6) + 0.0 END peak FROM v_audio")
def hook_preprocessor(spark, sf):
    """A preprocessor that breaks its contract in four ways, each for some of the clips."""
    def clip(a):
        if a[0] > 0:
            return a.clip(-0.1, 0.1)
        return a[:-1] if a[1] > 0 else a.astype("float32") if a[2] > 0 else a.tolist() if a[3] > 0 else a[len(a)]

    out = H.with_preprocessor(S.audio(spark, sf).select("clip", "samples"), clip)
    return out.select("clip", "error", r6(F.array_max("samples"), "peak"))


def bracket_translator():
    """A stand-in translator, which also shows how much context it saw; it refuses a few texts and is slow for a few."""

    def translate(text, source, target, before):
        if text.endswith("x"):
            raise ValueError(text)
        if text.startswith("zz"):
            time.sleep(5)
        return f"[{text}]/{len(before)}"

    return translate


BEFORE = "length(coalesce(array_to_string(list(text) OVER (PARTITION BY source_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)), ''))"


@query("hook_translator", f"SELECT source_id, turn, CASE WHEN text <> '' AND NOT text LIKE '%x' AND NOT text LIKE 'zz%' THEN '[' || text || ']/' || {BEFORE} END AS translated, CASE WHEN text LIKE '%x' THEN 'ValueError' WHEN text LIKE 'zz%' THEN 'timeout' END AS error FROM v_utt")
def hook_translator(spark, sf):
    """Translations with the two texts before, a deadline and an error for each row."""
    u = context_of(S.utterances(spark, sf), 2, own=True)
    t = H.translation(F.col("text"), F.col("context"), "en", "ja", bracket_translator, seconds=1.0)
    return u.withColumn("t", t).select("source_id", "turn", "t.translated", "t.error")


@query("hook_callbacks", """
SELECT source_id, turn, 'interim' kind, NULL::BOOLEAN emitted FROM v_utt WHERE NOT is_final UNION ALL SELECT source_id, turn, 'result', true FROM v_utt WHERE is_final AND confidence >= 0.2
UNION ALL SELECT source_id, turn, 'settled', confidence >= 0.2 FROM v_utt WHERE is_final""")
def hook_callbacks(spark, sf):
    """Provisional rows, results and then settled rows of a stream, batch by batch, to three sinks; each batch's rows replace those of an attempt that failed."""
    u = S.utterances(spark, sf).select("source_id", "turn", "text", "confidence", "is_final")
    path, ok = scratch_path(spark, "callbacks"), F.col("confidence") >= 0.2
    rows = lambda d, kind, emitted: d.select("source_id", "turn", F.lit(kind).alias("kind"), emitted.alias("emitted"))
    J.each_batch(
        J.stream_of(spark, u, "utterances", 5, ["source_id", "turn"]), path,
        lambda d, n: J.overwrite_epoch(rows(d.filter(ok), "result", F.lit(True)), f"{path}/result", n),
        lambda d, n: J.overwrite_epoch(rows(d, "interim", F.lit(None).cast("boolean")), f"{path}/interim", n),
        lambda d, n: J.overwrite_epoch(rows(d, "settled", ok), f"{path}/settled", n),
    )
    sinks = [spark.read.schema("source_id long, turn long, kind string, emitted boolean").parquet(f"{path}/{kind}/*") for kind in ("interim", "result", "settled")]
    return sinks[0].union(sinks[1]).union(sinks[2])


# the whole chain -------------------------------------------------------------------------------------

#: Frames of a chunk, the peak below which a segment is not scored, and the least confidence.
CHUNK, PEAK, SURE = 16, 100.0, 0.105


def length_scorer():
    """A stand-in scorer: words for long segments and loud ones, nothing for some; the confidence follows the peak."""

    def score(a, rate):
        n = len(a)
        text = "" if n % 7 == 0 else f"w{n}" if a[0] < 60 else f"a text of {n}"
        return text, float(a.max()) / 1000

    return score


S.SQL["v_spoken"] = f"""WITH RECURSIVE {machine_sql(3, 3, 5, 30)}, s AS (SELECT source_id, fin_start, ts FROM m WHERE fin)
SELECT s.source_id, fin_start start_time, s.ts end_time, count(*) n, max(value) peak, arg_min(value, frame_idx) head, max(frame_idx) // {CHUNK} * {CHUNK} * 0.032::DOUBLE tick
FROM s JOIN v_frames f ON f.source_id = s.source_id AND f.ts_s > fin_start + 0.016 AND f.ts_s < s.ts + 0.016 GROUP BY ALL"""
S.SQL["v_scored"] = f"""SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY end_time) turn, start_time, end_time, tick, peak / 1000 confidence, CASE WHEN source_id % 2 = 0 THEN 'en' END AS language,
 CASE WHEN n % 7 = 0 THEN '' WHEN head < 60 THEN 'w' || n ELSE 'a text of ' || n END AS text,
 CASE WHEN peak < {PEAK} THEN 'energy_gate' WHEN n % 7 = 0 THEN 'engine_empty' WHEN peak / 1000 < {SURE} THEN 'filter_reject' END AS reason FROM v_spoken"""
S.SQL["v_heard"] = "SELECT * FROM v_scored WHERE reason IS NULL"


@query("caption_chain", f"""
WITH {coalesce_sql('v_heard', 'u.tick < m.h.e + 1', 1)}, ends AS (SELECT source_id, count(*) // {CHUNK} * {CHUNK} * 0.032::DOUBLE clock FROM v_frames GROUP BY ALL),
told AS (SELECT source_id, unnest(e) w FROM m UNION ALL SELECT source_id, h FROM m JOIN ends USING (source_id) WHERE i = n AND h IS NOT NULL AND clock >= h.e + 1),
said AS (SELECT *, length(coalesce(array_to_string(list(w.t) OVER (PARTITION BY source_id ORDER BY w.s ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)), '')) before FROM told)
SELECT source_id, 'result' kind, NULL::VARCHAR reason, w.t AS text, round(w.s, 6) start_time, round(w.e, 6) end_time, w.k merged, '[' || w.t || ']/' || before AS translated FROM said
UNION ALL SELECT source_id, 'settled', NULL, NULL, round(w.s, 6), round(w.e, 6), w.k, NULL FROM said
UNION ALL SELECT source_id, 'settled', reason, NULL, round(start_time, 6), round(end_time, 6), NULL, NULL FROM v_scored WHERE reason IS NOT NULL""")
def caption_chain(spark, sf):
    """One stream from frames to translated captions: state machine, energy gate, scorer, filter, coalescer with the audio clock, translator, and two sinks."""
    f = S.frames(spark, sf).select("source_id", "frame_idx", "ts_s", "p", "value")
    s = J.speech_stream(J.stream_of(spark, f, "frames", BATCHES // 2, ["source_id", "frame_idx"]), CONFIG, CHUNK)
    quiet = F.array_max("samples") < PEAK
    s = s.withColumn("quiet", quiet).withColumn("samples", F.when(~quiet, F.col("samples")))
    s = H.with_scorer(s, length_scorer, 31)
    reason = F.when(F.col("quiet"), "energy_gate").when(F.col("text") == "", "engine_empty").when(F.col("confidence") < SURE, "filter_reject")
    s = s.withColumns({"reason": reason, "language": F.when(F.col("source_id") % 2 == 0, "en")})
    s = J.settled_stream(s, 1.0)
    s = s.withColumns({"is_final": F.lit(True), "translated": H.translated(F.col("text"), F.col("context"), "en", "ja", bracket_translator)})
    path = scratch_path(spark, "chain")
    each = ["start_time", "end_time", "merged"]
    row = lambda d, kind, *own: d.select("source_id", F.lit(kind).alias("kind"), *own)
    none = F.lit(None).cast("string")
    J.each_batch(
        s, path,
        on_result=lambda d, n: J.overwrite_epoch(row(d.filter("emitted"), "result", none.alias("reason"), "text", *each, "translated"), f"{path}/result", n),
        on_settled=lambda d, n: J.overwrite_epoch(row(d, "settled", "reason", none.alias("text"), *each, none.alias("translated")), f"{path}/settled", n),
    )
    schema = "source_id long, kind string, reason string, text string, start_time double, end_time double, merged int, translated string"
    sinks = [spark.read.schema(schema).parquet(f"{path}/{kind}/*") for kind in ("result", "settled")]
    return round_doubles(sinks[0].union(sinks[1]))
