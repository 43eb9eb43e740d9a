"""Streams whose rows come in no order, over many micro-batches, and the hooks' failures."""

import pickle
import random
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import hooks
from cadenza.operators import segments as G
from cadenza.runtime import scratch_path
from cadenza.streaming import jobs, ordered

CONFIG = G.VadConfig(min_speech_ms=96, min_silence_ms=96, speech_pad_ms=160, max_speech_ms=960)


def test_scattered_frames_equal_the_machine(spark):
    """Frames of three sources over 21 micro-batches in no order, a third of them handed out twice."""
    rng = np.random.default_rng(5)
    series = {s: (np.repeat(rng.random(40), 6) > 0.5).astype(float) for s in range(3)}
    rows = [(s, i, (i + 1) * 0.032, float(p)) for s, ps in series.items() for i, p in enumerate(ps)]
    d = spark.createDataFrame(rows + rows[::3], "source_id long, frame_idx long, ts_s double, p double").withColumn("k", F.monotonically_increasing_id())
    s = jobs.stream_of(spark, d, "frames", 21, ["source_id", "k"]).drop("k")
    out, late, batches = jobs.run_counted(jobs.vad_stream(s, CONFIG), "segments")
    want = set()
    for source, ps in series.items():
        machine = G.SpeechMachine(CONFIG)
        want |= {(source, *x) for i, p in enumerate(ps) for x in machine.step(float(p), (i + 1) * 0.032)}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want) > 10 and late == 0 and batches >= 20


def test_chunks_wait_for_those_before_them(spark):
    rng = random.Random(1)
    chunks = {s: [[float(100 * s + rng.random()) for _ in range(rng.randint(0, 9))] for _ in range(30)] for s in range(2)}
    d = spark.createDataFrame([(s, i, c) for s, cs in chunks.items() for i, c in enumerate(cs)], "source_id long, seq long, samples array<double>")
    out = jobs.run_available(jobs.frame_stream(jobs.stream_of(spark, d, "chunks", 6, ["source_id", "seq"]), 7), "frames")
    got = {(r["source_id"], r["frame_idx"]): r["samples"] for r in out.collect()}
    flat = {s: [x for c in cs for x in c] for s, cs in chunks.items()}
    assert got == {(s, i): xs[7 * i : 7 * i + 7] for s, xs in flat.items() for i in range(len(xs) // 7)}


def test_late_rows_are_counted(spark):
    """A row behind the watermark is dropped by the first operator that looks, once."""
    d = spark.createDataFrame([(i, 3600 * i) for i in range(1, 9)] + [(100, 3600), (101, 7200)], "event_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    s = jobs.slices_of(spark, d, "events", F.when(F.col("event_id") >= 100, 4).otherwise(F.floor(F.col("event_id") / 3)), 5).withWatermark("ts", "1 hour")
    out, late, batches = jobs.run_counted(s.dropDuplicatesWithinWatermark(["event_id"]), "late")
    assert sorted(r["event_id"] for r in out.collect()) == list(range(1, 9)) and late == 2 and batches == 4


def test_a_killed_batch_leaves_no_duplicates(spark):
    """The run dies between the two sinks of its second batch; the next run hands that batch out again, and both sinks hold every row once."""
    d = spark.createDataFrame([(i, i % 4 != 0) for i in range(40)], "turn long, is_final boolean")
    path, order = scratch_path(spark, "killed"), []
    stream = lambda: spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    d.repartition(4, "turn").write.parquet(f"{path}/in")

    def sink(kind, dies=None):
        def write(rows, epoch):
            if dies == epoch:
                raise RuntimeError("killed")
            order.append((epoch, kind))
            jobs.overwrite_epoch(rows.select("turn"), f"{path}/{kind}", epoch)

        return write

    with pytest.raises(Exception, match="killed"):
        jobs.each_batch(stream(), path, sink("result"), sink("interim"), sink("settled", dies=1))
    assert order == [(0, "interim"), (0, "result"), (0, "settled"), (1, "interim"), (1, "result")]
    jobs.each_batch(stream(), path, sink("result"), sink("interim"), sink("settled"))
    held = lambda kind: sorted(r["turn"] for r in spark.read.schema("turn long").parquet(f"{path}/{kind}/*").collect())
    assert held("result") == held("settled") == [i for i in range(40) if i % 4] and held("interim") == [i for i in range(40) if not i % 4]
    assert order[5:8] == [(1, "interim"), (1, "result"), (1, "settled")]


@pytest.fixture(scope="module")
def clips(spark):
    return spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "clip int, samples array<double>").coalesce(1)


def kinds(good, bad_type):
    """A model that by the clip's number answers, fails, is slow or answers with another type."""

    def call(a, *_):
        k = int(a[0])
        if k == 1:
            raise KeyError(k)
        if k == 2:
            time.sleep(3)
        return bad_type(a) if k == 3 else good(a)

    return call


def test_models_that_fail_or_are_slow(clips):
    errors = lambda d: [r["error"] for r in d.orderBy("clip").collect()]
    want = [None, "KeyError", "timeout", "TypeError", None, None]
    assert errors(hooks.with_scorer(clips, lambda: kinds(lambda a: ("x", 0.5), lambda a: 7), 2, seconds=0.5)) == want
    assert errors(hooks.with_segmenter(clips, kinds(lambda a: [(0.0, 1.0)], lambda a: [5]), 2, seconds=0.5)) == want
    assert errors(hooks.with_preprocessor(clips, kinds(lambda a: a * 2, lambda a: a.tolist()), seconds=0.5)) == want
    assert errors(hooks.with_preprocessor(clips, lambda a: a.astype("float32") if a[0] else np.zeros((2, 1)))) == ["length changed"] + ["type changed"] * 5
    got = hooks.with_preprocessor(clips, kinds(lambda a: a * 2, lambda a: None), seconds=0.5).orderBy("clip").collect()
    assert [r["samples"] for r in got] == [[0.0, 2.0], None, None, None, [8.0, 2.0], [10.0, 2.0]]


def test_translator_deadline(spark):
    d = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "slow"), (4, "typed"), (5, ""), (6, None)], "i int, text string").coalesce(1)

    def opener():
        def translate(text, source, target, before):
            if text == "bad":
                raise ValueError
            if text == "slow":
                time.sleep(3)
            return 5 if text == "typed" else text.upper() + before

        return translate

    t = hooks.translation(F.col("text"), F.lit("!"), "en", "ja", opener, seconds=0.5)
    got = [(r["t"]["translated"], r["t"]["error"]) for r in d.withColumn("t", t).orderBy("i").collect()]
    assert got == [("GOOD!", None), (None, "ValueError"), (None, "timeout"), (None, "TypeError"), (None, None), (None, None)]


def test_a_model_that_hangs_stalls():
    """Threads that are left behind are bounded; later calls fail at once."""
    call = hooks.Deadline(0.01)
    got = [call(time.sleep, 2)[1] for _ in range(hooks.ABANDONED + 3)]
    assert got == ["timeout"] * hooks.ABANDONED + ["stalled"] * 3
    assert hooks.Deadline(None)(lambda: 3) == (3, None) and hooks.Deadline(5)(lambda: 3) == (3, None)


def test_chain_of_two_folds_equals_chunks_in_turn(spark):
    """Frames in no order through the machine and the coalescer, against chunks of frames fed one after the other."""
    rng, chunk, window = np.random.default_rng(11), 7, 0.6
    series = {s: [(float(p), float(i)) for i, p in enumerate((np.repeat(rng.random(60), rng.integers(2, 9, 60)) > 0.5).astype(float))] for s in range(4)}
    text = lambda values: ["", "ab", "ok", "a long text."][int(values[0]) % 4]

    want, spans = [], set()
    for source, frames in series.items():
        machine, held, before, kept = G.SpeechMachine(CONFIG), None, [], []

        def emit(r):
            want.append((source, True, None, r["text"], r["start_time"], r["end_time"], r["confidence"], r["merged"], "\n".join(before)))
            before[:] = [*before, r["text"]][-2:]

        for i, (p, value) in enumerate(frames):
            now = (i + 1) * 0.032
            kept.append((now, value))
            for start, end, _ in machine.step(p, now):
                values = [v for t, v in kept if start + 0.016 < t < end + 0.016]
                spans.add((source, start, end, tuple(values)))
                said = text(values)
                if not said:
                    want.append((source, False, "engine_empty", None, start, end, None, None, None))
                    continue
                new = {"text": said, "start_time": start, "end_time": end, "confidence": 1 / (1 + values[0]), "language": "en", "merged": 1}
                held, done = G.push(held, new, window)
                for r in done:
                    emit(r)
            if (i + 1) % chunk == 0 and held and now >= held["end_time"] + window:
                emit(held)
                held = None

    rows = [(s, i, (i + 1) * 0.032, p, v) for s, fs in series.items() for i, (p, v) in enumerate(fs)]
    d = spark.createDataFrame(rows, "source_id long, frame_idx long, ts_s double, p double, value double")
    speech = jobs.speech_stream(jobs.stream_of(spark, d, "frames", 5, ["source_id", "frame_idx"]), CONFIG, chunk)
    said = F.when(~F.col("clock"), F.element_at(F.array(*map(F.lit, ["", "ab", "ok", "a long text."])), (F.col("samples")[0] % 4 + 1).cast("int")))
    first = F.col("samples")[0]
    scored = speech.withColumns({"text": said, "confidence": 1 / (1 + first), "language": F.lit("en"), "reason": F.when(said == "", "engine_empty")})
    got = [tuple(r) for r in jobs.run_available(jobs.settled_stream(scored.drop("samples"), window), "settled").collect()]
    key = lambda r: (r[0], r[4], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[7] for r in want if r[1]} >= {1, 2} and any(not r[1] for r in want)
    again = jobs.stream_of(spark, d, "frames", 2, ["source_id", "frame_idx"])
    out = jobs.run_available(jobs.speech_stream(again, CONFIG, chunk), "speech").filter("not clock").collect()
    assert {(r["source_id"], r["start_time"], r["end_time"], tuple(r["samples"])) for r in out} == spans


def test_a_held_utterance_waits_for_the_cell_that_its_window_reaches(spark):
    """The watermark passes the window of "ab" while "cd", which merges with it, still waits in the next cell."""
    schema = "source_id long, turn long, text string, start_time double, end_time double, confidence double, language string, slice int"
    rows = [(1, 0, "ab", 59.0, 59.5, 0.5, "en", 0), (1, 1, "cd", 60.5, 61.0, 0.5, "en", 0), (2, 0, "long enough.", 75.0, 76.0, 0.5, "en", 1), (2, 1, "and again.", 80.0, 81.0, 0.5, "en", 2), (2, 2, "the last.", 200.0, 201.0, 0.5, "en", 3), (2, 3, "the very last.", 201.0, 202.0, 0.5, "en", 4)]
    d = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis((F.col("start_time") * 1000 + 1).cast("long")))
    s = jobs.slices_of(spark, d, "border", F.col("slice"), 5).drop("slice").withWatermark("ts", "1 second")
    got = [tuple(r) for r in jobs.run_available(jobs.coalesce_stream(s, 3.0, 60_000), "border-out").filter("source_id = 1").select("text", "end_time", "merged").collect()]
    assert got == [("ab cd", 61.0, 2)]


def test_results_without_text_confidence_or_language(spark):
    """Nulls have a defined result, and no rows give none."""
    schema = "source_id long, seq long, clock boolean, start_time double, end_time double, text string, confidence double, language string, reason string"
    rows = [(1, 0, False, 0.0, 1.0, "a", None, None, None), (1, 1, False, 1.5, 2.0, "b", 0.5, None, None), (1, 2, True, 3.0, 3.0, None, None, None, None), (1, 3, True, 9.0, 9.0, None, None, None, None)]
    rows += [(2, 0, False, 0.0, 1.0, None, None, None, None), (2, 1, False, 1.0, 2.0, "alone it stays.", None, None, None), (2, 2, False, 2.0, 3.0, "c", None, None, "late")]
    run = lambda r: [tuple(x) for x in jobs.run_available(jobs.settled_stream(jobs.stream_of(spark, spark.createDataFrame(r, schema), "results", 2, ["seq"]), 5.0), "settled").collect()]
    got = sorted(run(rows), key=str)
    assert got == sorted([(1, True, None, "ab", 0.0, 2.0, 0.5, 2, ""), (2, True, None, "", 0.0, 1.0, None, 1, ""), (2, True, None, "alone it stays.", 1.0, 2.0, None, 1, ""), (2, False, "late", None, 2.0, 3.0, None, None, None)], key=str)
    assert run([]) == []


@pytest.mark.parametrize("size", [4, 1000])
def test_coalescer_with_a_clock_equals_chunks_in_turn(spark, size):
    rng, chunk, window = random.Random(4), 0.5, 2.0
    rows = []
    for s in range(3):
        t = 0.0
        for turn in range(60):
            start = t + rng.choice([0.0, 0.25, 1.0, 1.75, 2.0, 2.5])
            t = start + rng.choice([0.25, 0.5, 1.0, 3.0])
            rows.append((s, turn, rng.choice(["ab", "ok", "a long text.", "yes"]), start, t, rng.random(), "en"))
    d = spark.createDataFrame(rows, "source_id long, turn long, text string, start_time double, end_time double, confidence double, language string")
    want = []
    for s in range(3):
        mine = [r for r in rows if r[0] == s]
        held, out = None, []
        for k in range(1, int(mine[-1][4] / chunk) + 2):
            for r in (r for r in mine if (k - 1) * chunk < r[4] <= k * chunk):
                held, done = G.push(held, dict(zip([*G.UTTERANCE, "merged"], (*r[2:], 1), strict=True)), window)
                out += done
            if held and k * chunk >= held["end_time"] + window:
                held, out = None, [*out, held]
        want += [(s, r["text"], r["start_time"], r["end_time"], r["merged"]) for r in [*out, *([held] if held else [])]]
    cols = ["source_id", "text", "start_time", "end_time", "merged"]
    got = [tuple(r) for r in G.coalesce_utterances(d.repartition(5), window, size=size, chunk=chunk).select(cols).collect()]
    assert sorted(got) == sorted(want)
    plain = [tuple(r) for r in G.coalesce_utterances(d, window).select(cols).collect()]
    assert len(plain) < len(got)  # the clock ends some waits that the push rule alone would not


class Store:
    """State of one group as the processors see it, which counts calls and the rows of each cell."""

    def __init__(self):
        self.held, self.value, self.calls, self.most = {}, None, 0, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.count(self.value), update=lambda v: self.count(setattr(self, "value", v)))

    def count(self, out=None):
        self.calls += 1
        return out

    def getValue(self, key):
        return self.count(self.held.get(key))

    def updateValue(self, key, value):
        self.most = max(self.most, len(pickle.loads(value[0])))
        self.count(self.held.__setitem__(key, value))

    def removeKey(self, key):
        self.count(self.held.pop(key))


@pytest.mark.parametrize(("sources", "length", "room"), [(32, 66, 4096), (1, 500, 16), (3, 100, 24)])
def test_a_micro_batch_costs_a_group_a_few_calls(monkeypatch, sources, length, room):
    """Rows over 20 micro-batches in no order, some handed out twice: outputs in order, calls by cells and not by rows or sources, and no cell of more rows than there is room."""
    monkeypatch.setattr(ordered, "ROOM", room)
    fold = ordered.Sequenced("s", "i", ["x"], (0,), lambda state, row, out: out.append((state[0], row[0])) or (state[0] + 1,), ["s", "n", "x"], sources)
    store, rng, got = Store(), random.Random(3), []
    fold.init(store)
    batches = [[] for _ in range(20)]
    for s in range(sources):
        for i in range(length):
            for b in {rng.randrange(20), *([rng.randrange(20)] if i % 5 == 0 else [])}:
                batches[b].append((s, i, s + i / 1000))
    for rows in batches:
        rng.shuffle(rows)
        half = len(rows) // 2
        for pdf in fold.handleInputRows((0,), iter([pd.DataFrame(r, columns=["s", "i", "x"]) for r in (rows[:half], rows[half:]) if r]), None):
            got += pdf.itertuples(index=False, name=None)
    for s in range(sources):
        assert [(n, x) for k, n, x in got if k == s] == [(i, s + i / 1000) for i in range(length)]
    cells = -(-length // (room // sources))
    assert store.calls <= 20 * (2 + 3 * cells) and store.most <= room and not store.held


def test_calls_in_time_share_a_thread():
    """A new thread takes over from one that is late, and threads end with their deadline."""
    import threading

    call, seen = hooks.Deadline(0.2), set()
    here = lambda *_: seen.add(threading.get_ident())
    for _ in range(50):
        assert call(here) == (None, None)
    assert len(seen) == 1 and call(time.sleep, 1) == (None, "timeout") and call(lambda x: 1 / x, 0) == (None, "ZeroDivisionError")
    call(here)
    assert len(seen) == 2
    threads = [call.at_work[0], *call.late]
    del call
    [t.join(3) for t in threads]
    assert len(threads) == 2 and not any(t.is_alive() for t in threads)
