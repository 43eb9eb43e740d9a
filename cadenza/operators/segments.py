"""Segments from scored frames, and utterances from recognised segments, as batch jobs.

``hysteresis_segments`` is relational (gaps and islands). The state machine, the coalescer and the
envelope gate depend on all that came before in a source: they fold a source's rows in order. A source is
first cut where the state is surely silent, so a fold's group is a stretch of activity, not a whole
source. The gate, which is never surely silent, runs cell by cell from the state that the cells before it
leave.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.operators.windows import CELL
from cadenza.runtime import materialise

FRAME_S = 0.032


def hysteresis_segments(frames: DataFrame, threshold: float, min_silence: int, min_frames: int = 1, max_frames: int | None = None, key: str = "source_id", idx: str = "frame_idx", p: str = "p", size: int = CELL) -> DataFrame:
    """(key, start_frame, end_frame): runs of frames of at least the threshold; silences shorter than min_silence frames stay inside.

    A source is cut into cells of ``size`` frames, so a long one is many tasks' work. Runs under min_frames go; runs over max_frames split into equal whole parts, the remainder in the last, parts under min_frames go.
    """
    s = frames.filter(F.col(p) >= threshold).select(key, F.col(idx).alias("i")).withColumn("__c", F.floor(F.col("i") / size))
    s = s.withColumn("__was", F.lag("i").over(W.partitionBy(key, "__c").orderBy("i")))
    # one row a cell carries its last frame on to the next
    ends = s.groupBy(key, "__c").agg(F.max("i").alias("__e")).select(key, "__c", F.lag("__e").over(W.partitionBy(key).orderBy("__c")).alias("__before"))
    s = s.join(ends, [key, "__c"]).withColumn("new", F.coalesce(F.col("i") - F.coalesce("__was", "__before") - 1 >= min_silence, F.lit(True)))
    s = stretches(s.select(key, "i", "new"), key, "i", "new", size).withColumnRenamed("stretch", "island")
    runs = s.groupBy(key, "island").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b")).filter(F.col("b") - F.col("a") >= min_frames)
    if max_frames is None:
        return runs.select(key, F.col("a").alias("start_frame"), F.col("b").alias("end_frame"))
    d = F.col("b") - F.col("a")
    k = F.ceil(d / max_frames)
    parts = runs.select(key, "a", "b", k.alias("k"), F.floor(d / k).alias("size"), F.explode(F.sequence(F.lit(0), k - 1)).alias("j"))
    start = F.col("a") + F.col("j") * F.col("size")
    end = F.when(F.col("j") == F.col("k") - 1, F.col("b")).otherwise(start + F.col("size"))
    return parts.select(key, start.alias("start_frame"), end.alias("end_frame")).filter(F.col("end_frame") - F.col("start_frame") >= min_frames)


@dataclass(frozen=True)
class VadConfig:
    """Fixed default values of the speech state machine."""

    threshold: float = 0.5
    min_speech_ms: int = 250
    min_silence_ms: int = 100
    speech_pad_ms: int = 100
    max_speech_ms: int = 0
    interim_min_ms: int = 2000
    interim_interval_ms: int = 1000

    def frames(self, ms: int) -> int:
        return max(1, ms // 32)


START = ("silence", 0, 0, 0, 0.0, 0, 0.0, 0)


class SpeechMachine:
    """Silence, potential speech, speech, ending. ``step`` takes a frame and gives the finished or provisional segments.

    state: mode, frames in the pre-buffer, speech and silent counts, start, frames held, and the time and
    held frames of the last provisional row. Provisional rows follow the frames' clock.
    """

    def __init__(self, config: VadConfig, state: tuple = START):
        self.c = config
        self.min_speech, self.min_silence, self.pad = (config.frames(ms) for ms in (config.min_speech_ms, config.min_silence_ms, config.speech_pad_ms))
        self.mode, self.pre, self.loud, self.quiet, self.start, self.held, self.told_at, self.told = state

    @property
    def state(self) -> tuple:
        return (self.mode, self.pre, self.loud, self.quiet, self.start, self.held, self.told_at, self.told)

    def _reset(self) -> None:
        self.mode, self.pre, self.loud, self.quiet, self.start, self.held, self.told_at, self.told = START

    def _end(self, t: float) -> list[tuple[float, float, bool]]:
        out = [(self.start, t, True)]
        self._reset()
        return out

    def step(self, p: float, t: float, interim: bool = False) -> list[tuple[float, float, bool]]:
        """t is the frame's end time. Segments are (start, end, is_final)."""
        speech = p >= self.c.threshold
        if self.mode == "silence":
            self.pre = min(self.pre + 1, self.pad)
            if speech:  # the onset frame stands in the pre-buffer and once more in the segment
                self.mode, self.loud, self.start, self.held = "potential", 1, max(0.0, t - self.pre * FRAME_S), self.pre + 1
            return []
        self.held += 1
        self.quiet = 0 if speech else self.quiet + 1  # not set back on entering the ending
        if self.mode == "potential":
            self.loud += speech
            if speech and self.loud >= self.min_speech:
                self.mode = "speech"
            elif self.quiet >= self.min_silence:
                self._reset()
            return []
        if self.mode == "ending":
            if speech:
                self.mode = "speech"
            return self._end(t) if self.quiet >= self.pad else []
        if self.quiet >= self.min_silence:
            self.mode = "ending"
        if self.c.max_speech_ms and self.held * 32 >= self.c.max_speech_ms:
            return self._end(t)
        if interim and (self.held - self.told) * 32 >= self.c.interim_min_ms and (t - self.told_at) * 1000 >= self.c.interim_interval_ms:
            self.told_at, self.told = t, self.held
            return [(self.start, t, False)]
        return []

    def finish(self, t: float) -> list[tuple[float, float, bool]]:
        """At the end of a source; unconfirmed speech counts too."""
        return [] if self.mode == "silence" else self._end(t)


def stretches(rows: DataFrame, key: str, order: str, begins: str, size: int = CELL) -> DataFrame:
    """rows with ``stretch``: the order value of the last row of its key, up to itself, for which the flag ``begins`` holds.

    Cells of a key are numbered apart, and one row a cell carries its last beginning on to the next.
    """
    start = F.when(F.col(begins), F.col(order))
    d = rows.withColumn("__cell", F.floor(F.col(order) / size))
    d = d.withColumn("__own", F.last(start, ignorenulls=True).over(W.partitionBy(key, "__cell").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    carried = F.max("last").over(W.partitionBy(key).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1))
    before = d.groupBy(key, "__cell").agg(F.max(start).alias("last")).select(key, "__cell", carried.alias("__before"))
    return d.join(before, [key, "__cell"]).withColumn("stretch", F.coalesce("__own", "__before", F.lit(-1))).drop("__cell", "__own", "__before")


def folded(rows: DataFrame, keys: list[str], order: str, schema: str, start, step, finish) -> DataFrame:
    """A fold over the rows of every group of keys in order: rows are sorted within tasks and stream through in Arrow batches.

    start() gives a state, step(state, row tuple, out) the next one, finish(state, key tuple, out) ends a group;
    results are appended to the list out. A group is never held.
    """
    names = rows.columns
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    at = [names.index(k) for k in keys]
    fields = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        now, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            for row in zip(*(pdf[c].tolist() for c in names), strict=True):
                key = tuple(row[i] for i in at)
                if key != now:
                    if now is not None:
                        finish(state, now, out)
                    now, state = key, start()
                state = step(state, row, out)
            yield pd.DataFrame(out, columns=fields)
        if now is not None:
            out = []
            finish(state, now, out)
            yield pd.DataFrame(out, columns=fields)

    return dealt.mapInPandas(run, schema)


def silent_cuts(frames: DataFrame, config: VadConfig, key: str = "source_id", idx: str = "frame_idx", size: int = CELL) -> DataFrame:
    """frames with ``stretch``: pieces that begin where so many silent frames lie behind that the machine is silent and its pre-buffer full.

    Whether a piece begins shows within a bounded span around a frame, so cells that overlap by it find all.
    """
    quiet = config.frames(config.min_silence_ms) + 2 * config.frames(config.speech_pad_ms) + 2
    lead = max(config.frames(config.speech_pad_ms), 1)  # a piece begins pad frames before an onset, among silent frames
    back = quiet + lead + 1
    cell, own = F.floor(F.col(idx) / size), F.pmod(F.col(idx), F.lit(size))
    d = frames.withColumn("__own", cell).withColumn("__cell", F.explode(F.array_compact(F.array(cell, F.when(own < lead, cell - 1), F.when(own >= size - back - lead, cell + 1)))))
    w = W.partitionBy(key, "__cell").orderBy(idx)
    loud = F.col("p") >= config.threshold
    last = F.coalesce(F.last(F.when(loud, F.col(idx)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first(idx).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    onset = loud & (F.col(idx) - last > quiet + lead)
    d = d.withColumn("__b", F.coalesce(F.lead(onset, lead).over(w), F.lit(False))).filter("__cell = __own").drop("__cell", "__own")
    return stretches(d, key, idx, "__b", size).drop("__b")


def vad_segments(frames: DataFrame, config: VadConfig = VadConfig(), interim: bool = False, key: str = "source_id", size: int = CELL) -> DataFrame:
    """(key, start_time, end_time, is_final) of the state machine over frames(key, frame_idx, ts_s, p).

    A stretch that is not its source's last ends in silence, so finishing it tells nothing.
    """
    cut = silent_cuts(frames.select(F.col(key).alias("source_id"), "frame_idx", "ts_s", "p"), config, size=size).select("source_id", "stretch", "frame_idx", "ts_s", "p")

    def step(state, row, out):
        machine, _ = state
        out += [(row[0], *s) for s in machine.step(row[4], row[3], interim)]
        return machine, row[3]

    def finish(state, key_, out):
        out += [(key_[0], *s) for s in state[0].finish(state[1])]

    schema = "source_id long, start_time double, end_time double, is_final boolean"
    return folded(cut, ["source_id", "stretch"], "frame_idx", schema, lambda: (SpeechMachine(config), 0.0), step, finish).withColumnRenamed("source_id", key)


#: Fields of an utterance, in order.
UTTERANCE = ["text", "start_time", "end_time", "confidence", "language"]


def short(text: str, max_words: int = 1, max_chars: int = 4) -> bool:
    from cadenza.functions.text import ENDS

    t = text.strip()
    if not t or t[-1] in ENDS:
        return False
    n = len(t.split())
    return n <= max_words if n >= 2 else len(t) <= max_chars


def joined(a: dict, b: dict) -> dict:
    """Two utterances as one: start and source of a, end of b, the lesser confidence."""
    from cadenza.functions.text import SPACED

    language = a["language"] or b["language"]
    spaced = language[:2].lower() in SPACED if language else " " in a["text"] or " " in b["text"]
    return a | {"text": a["text"] + (" " if spaced else "") + b["text"], "end_time": b["end_time"], "confidence": min(a["confidence"], b["confidence"]), "language": language, "merged": a["merged"] + b["merged"]}


def timed_out(end, next_end, window: float, chunk: float, ceiling=ceil):
    """Whether a chunk of audio ends at least the window after ``end`` and before the chunk that ``next_end`` lies in; for numbers, or columns with F.ceil."""
    return (ceiling(next_end / chunk) - 1) * chunk >= end + window


def push(held: dict | None, new: dict, window: float = 5.0, chunk: float | None = None) -> tuple[dict | None, list[dict]]:
    """(held, emitted) after a new utterance: a held short one merges with it inside the window, else leaves alone.

    With chunk (seconds) the audio comes in chunks, each of which ends by releasing what waits longer than the window; an
    utterance comes with the chunk that its end lies in.
    """
    out = []
    if held is not None:
        late = chunk is not None and timed_out(held["end_time"], new["end_time"], window, chunk)
        if new["start_time"] - held["end_time"] <= window and not late:
            new = joined(held, new)
        else:
            out.append(held)
    return (new, out) if short(new["text"]) else (None, [*out, new])


def coalesce_utterances(utterances: DataFrame, window: float = 5.0, key: str = "source_id", order: str = "turn", size: int = CELL, chunk: float | None = None) -> DataFrame:
    """Short utterances merged into the next of their source within the window; ``merged`` counts the parts. chunk: see ``push``.

    A source is cut before every utterance that starts beyond the window after the one before, or comes after that one
    has timed out, where nothing can merge.
    """
    u = utterances.select(F.col(key).alias("k"), F.col(order).alias("o"), *UTTERANCE).withColumn("__cell", F.floor(F.col("o") / size))
    u = u.withColumn("__end", F.lag("end_time").over(W.partitionBy("k", "__cell").orderBy("o")))
    # one row a cell carries the end of its last utterance on to the next
    last = u.groupBy("k", "__cell").agg(F.max_by("end_time", "o").alias("end")).select("k", "__cell", F.lag("end").over(W.partitionBy("k").orderBy("__cell")).alias("__before"))
    before = F.coalesce("__end", "__before")
    apart = F.col("start_time") - before > window
    if chunk is not None:
        apart = apart | timed_out(before, F.col("end_time"), window, chunk, F.ceil)
    u = u.join(last, ["k", "__cell"]).withColumn("__new", F.coalesce(apart, F.lit(True))).drop("__cell", "__end", "__before")
    u = stretches(u.withColumn("language", F.coalesce("language", F.lit(""))), "k", "o", "__new", size).select("k", "stretch", "o", *UTTERANCE)
    fields = [*UTTERANCE, "merged"]

    def emit(k, rows, out):
        out += [(k, *(r[f] for f in fields)) for r in rows]

    def step(held, row, out):
        new = dict(zip(UTTERANCE, row[3:], strict=True))
        held, done = push(held, new | {"language": new["language"] or None, "merged": 1}, window, chunk)
        emit(row[0], done, out)
        return held

    schema = "k long, text string, start_time double, end_time double, confidence double, language string, merged int"
    return folded(u, ["k", "stretch"], "o", schema, lambda: None, step, lambda held, k, out: emit(k[0], [held] if held else [], out)).withColumnRenamed("k", key)


@dataclass(frozen=True)
class GateConfig:
    open_level: float
    close_level: float
    attack: int
    release: int
    floor: float = 0.0


def gate_step(state: tuple[float, bool, int], x: float, c: GateConfig) -> tuple[float, bool, int]:
    """(envelope, open, hold) after a sample."""
    envelope, is_open, hold = state
    a = abs(x)
    envelope = envelope + (1 - exp(-1 / c.attack)) * (a - envelope) if a > envelope else envelope * exp(-1 / c.release)
    return envelope, *_gate(is_open, hold, envelope, c)


def _gate(is_open: bool, hold: int, envelope: float, c: GateConfig) -> tuple[bool, int]:
    """(open, hold) at an envelope."""
    if is_open:
        if envelope > c.close_level:
            return True, c.release
        return (True, hold - 1) if hold > 0 else (False, 0)
    return (True, c.release) if envelope > c.open_level else (False, hold)


#: Time constants of the envelope after which what lay before leaves no bit; a cell is as long at least.
MEMORY = 40


def _tail_ends(series: DataFrame, config: GateConfig, size: int) -> DataFrame:
    """(k, cell, end): the envelope after each cell, taken from its last rows alone."""
    reach = ceil(MEMORY * max(config.attack, config.release))

    def step(state, row, out):
        return gate_step((state, False, 0), row[3], config)[0]

    tail = series.filter(F.pmod("i", F.lit(size)) >= size - reach).select("k", "cell", "i", "x")
    return folded(tail, ["k", "cell"], "i", "k long, cell long, end double", lambda: 0.0, step, lambda state, key, out: out.append((*key, state)))


def _starts(ends: DataFrame) -> DataFrame:
    """(k, cell, e): the envelope before each cell, zero before a source's first; one row a cell."""
    return ends.select("k", "cell", F.coalesce(F.lag("end").over(W.partitionBy("k").orderBy("cell")), F.lit(0.0)).alias("e"))


def _gated_cells(series: DataFrame, starts: DataFrame, config: GateConfig) -> DataFrame:
    """Rows (k, cell, i, x, at, below, shut, wide, end, hold_shut, hold_wide) of each cell, folded from its starting envelope for either state of the gate.

    at counts the rows of a cell, below those before the envelope first exceeds the closing level. shut and wide say whether
    the gate is open after the row if it was closed before the cell, or open with no end of its hold; the last three are the
    envelope and the holds after the row.
    """

    def step(state, row, out):
        e, shut, wide, at, below, met = state if state else (row[4], (False, 0), (True, config.release), 0, 0, False)
        e, *_ = gate_step((e, False, 0), row[3], config)
        met = met or e > config.close_level
        shut = _gate(*shut, e, config)
        wide = _gate(*wide, e, config) if met else wide
        at, below = at + 1, below + (not met)
        out.append((row[0], row[1], row[2], row[3], at, below, shut[0], wide[0], e, shut[1], wide[1]))
        return e, shut, wide, at, below, met

    schema = "k long, cell long, i long, x double, at int, below int, shut boolean, wide boolean, end double, hold_shut int, hold_wide int"
    return folded(series.join(starts, ["k", "cell"]).select("k", "cell", "i", "x", "e"), ["k", "cell"], "i", schema, lambda: None, step, lambda state, key, out: None)


def _states(cells: DataFrame, config: GateConfig) -> DataFrame:
    """(k, cell, open, hold) before each cell, by running through one summary row a cell (of the row with its largest ``at``)."""

    def step(state, row, out):
        is_open, hold = state
        out.append((row[0], row[1], is_open, hold))
        _, _, n, below, shut, wide, hold_shut, hold_wide = row
        if is_open and hold >= below:
            return (True, hold - n) if below == n else (wide, hold_wide)
        return shut, hold_shut

    rows = cells.select("k", "cell", F.col("at").alias("n"), "below", "shut", "wide", "hold_shut", "hold_wide")
    return folded(rows, ["k"], "cell", "k long, cell long, open boolean, hold int", lambda: (False, 0), step, lambda state, key, out: None)


def hysteresis_gate(series: DataFrame, config: GateConfig, key: str = "source_id", order: str = "frame_idx", value: str = "value", size: int = CELL) -> DataFrame:
    """(key, order, value, open, gated): an envelope follower opens and closes with two levels and a hold; closed rows are scaled by the floor.

    Cells of a source run apart. Where the envelope stands before a cell is first taken from the last rows before it. All
    cells are then folded; if every cell began with the very number that the one before it ended with, all are right, since a
    source's first one is. Else the ends become the beginnings and the fold is repeated, which makes one more cell of each
    source right at least, and nearly always all.

    A cell is folded for a closed and for an open gate. An open gate with a hold of h stays open through the rows before the
    envelope first exceeds the closing level if these are h at most, and else closes for the rest of them, so these two
    folds tell the state after the cell for any state before it; one row a cell is run through for that.
    """
    if config.close_level > config.open_level:
        raise ValueError("a gate closes at its opening level or below")
    size = max(size, ceil(MEMORY * max(config.attack, config.release)))
    x = series.select(F.col(key).alias("k"), F.col(order).alias("i"), F.col(value).alias("x")).withColumn("cell", F.floor(F.col("i") / size))
    starts = materialise(_starts(_ends_of_all(x, _tail_ends(x, config, size))), "gate-starts")
    while True:
        rows = materialise(_gated_cells(x, starts, config), "gated")
        cells = materialise(rows.groupBy("k", "cell").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("k", "cell", "i", "x"))), "at").alias("s")).select("k", "cell", "s.*"), "gate-cells")
        after = _starts(cells)
        if after.join(starts.withColumnRenamed("e", "was"), ["k", "cell"]).filter("e != was").isEmpty():
            break
        starts = materialise(after, "gate-starts")
    before = _states(cells, config).join(cells.select("k", "cell", F.col("below").alias("all_below")), ["k", "cell"])
    out = rows.join(before, ["k", "cell"])
    opened = F.when(~F.col("open"), F.col("shut")).when(F.col("at") <= F.col("all_below"), F.col("at") <= F.col("hold"))
    opened = opened.when(F.col("hold") >= F.col("all_below"), F.col("wide")).otherwise(F.col("shut"))
    out = out.select("k", "i", "x", opened.alias("open"))
    return out.select(F.col("k").alias(key), F.col("i").alias(order), F.col("x").alias(value), "open", F.when(F.col("open"), F.col("x")).otherwise(F.col("x") * config.floor).alias("gated"))


def _ends_of_all(series: DataFrame, ends: DataFrame) -> DataFrame:
    """ends for every cell of the series; a cell without a last row that reaches its end (a gap) gets null, which counts as zero."""
    return series.select("k", "cell").distinct().join(ends, ["k", "cell"], "left")
