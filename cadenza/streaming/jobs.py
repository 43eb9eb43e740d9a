"""Structured Streaming twins of the keyed folds, and ways to run a stream over what is there.

Rows may come in any order: folds run on ``ordered.Sequenced`` (numbered rows) or ``ordered.Timed`` (rows in
event time). Micro-batches are bounded by the files of a trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import ceil, inf

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.segments import START, UTTERANCE, GateConfig, SpeechMachine, VadConfig, gate_step, push
from cadenza.runtime import materialise, scratch_path
from cadenza.streaming.ordered import Sequenced, Timed, grouped

SEGMENT = "source_id long, start_time double, end_time double, is_final boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


#: Neighbouring sources that share a group's state, where sources are many.
TOGETHER = 32


def in_sequence(rows: DataFrame, order: str, fields: list[str], start: tuple, step, out: str, key: str = "source_id", together: int = 1) -> DataFrame:
    """The outputs (schema out, the key first) of a fold over each key's rows, numbered by order from 0; together: see ``ordered``."""
    fold = Sequenced(key, order, fields, start, step, _names(out), together)
    return grouped(rows.select(key, order, *fields), key, together).transformWithStateInPandas(fold, out, "Append", "None")


def vad_stream(frames: DataFrame, config: VadConfig = VadConfig(), interim: bool = False) -> DataFrame:
    """Segments of frames(source_id, frame_idx, ts_s, p) as they close; with interim also provisional rows."""

    def step(state, row, out):
        machine = SpeechMachine(config, state)
        out += machine.step(row[1], row[0], interim)
        return machine.state

    return in_sequence(frames, "frame_idx", ["ts_s", "p"], START, step, SEGMENT, together=TOGETHER)


def speech_stream(frames: DataFrame, config: VadConfig = VadConfig(), chunk: int = 16) -> DataFrame:
    """(source_id, seq, clock, start_time, end_time, samples): finished segments with their frames' values, and the audio clock.

    frames(source_id, frame_idx, ts_s, p, value). After every ``chunk`` frames of a source comes a row without samples, for
    which clock is true and both times are the chunk's end. Rows of a source are numbered together, so a fold that follows sees them in this order. A frame
    stands once in its segment; a source waits with what its machine holds, never with more than one segment.
    """

    def step(state, row, out):
        machine = SpeechMachine(config, state[:8])
        values, seq, n = [*state[8], row[2]], state[9], state[10] + 1
        was = machine.mode
        for start, end, _ in machine.step(row[1], row[0]):
            out.append((seq, False, start, end, values))
            seq += 1
        if "silence" in (was, machine.mode):  # what the pre-buffer holds
            values = values[-machine.pre :] if machine.pre else []
        if n % chunk == 0:
            out.append((seq, True, row[0], row[0], None))
            seq += 1
        return (*machine.state, values, seq, n)

    out_type = "source_id long, seq long, clock boolean, start_time double, end_time double, samples array<double>"
    return in_sequence(frames, "frame_idx", ["ts_s", "p", "value"], (*START, [], 0, 0), step, out_type, together=TOGETHER)


def settled_stream(results: DataFrame, window: float = 5.0, context: int = 2) -> DataFrame:
    """What becomes of each result: emitted, alone or merged, with the texts before it, or dropped for its reason.

    results(source_id, seq, clock, start_time, end_time, text, confidence, language, reason), numbered as ``speech_stream``
    does, with its clock, which releases what is held once the window has passed. A null text is empty; a null confidence
    stays null and does not lower that of the texts it merges with.
    """
    fields = [*UTTERANCE, "merged"]

    def step(state, row, out):
        held = dict(zip(fields, state[:6], strict=True)) if state[5] else None
        clock, start, end, text, confidence, language, reason = row
        done, before = [], list(state[6])
        if clock:
            if held and end >= held["end_time"] + window:
                held, done = None, [held]
        elif reason:
            out.append((False, reason, None, start, end, None, None, None))
        else:
            new = {"text": text, "start_time": start, "end_time": end, "confidence": confidence, "language": language or None, "merged": 1}
            held, done = push(held, new, window)
        for r in done:
            out.append((True, None, r["text"], r["start_time"], r["end_time"], r["confidence"] if r["confidence"] < inf else None, r["merged"], "\n".join(before)))
            before = [*before, r["text"]][-context:] if context else []
        return (*(held[c] for c in fields), before) if held else (*none, before)

    none = ("", 0.0, 0.0, 0.0, None, 0)
    kinds = ["clock", "start_time", "end_time", "text", "confidence", "language", "reason"]
    out = "source_id long, emitted boolean, reason string, text string, start_time double, end_time double, confidence double, merged int, context string"
    known = {"text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(inf)), "language": F.coalesce("language", F.lit("")), "reason": F.coalesce("reason", F.lit(""))}
    return in_sequence(results.withColumns(known), "seq", kinds, (*none, []), step, out, together=TOGETHER)


def gate_stream(series: DataFrame, config: GateConfig) -> DataFrame:
    """The envelope gate over (source_id, frame_idx, value)."""

    def step(state, row, out):
        new = gate_step(state[:3], row[0], config)
        out.append((state[3], row[0], new[1]))
        return (*new, state[3] + 1)

    return in_sequence(series, "frame_idx", ["value"], (0.0, False, 0, 0), step, "source_id long, frame_idx long, value double, open boolean")


def frame_stream(chunks: DataFrame, size: int) -> DataFrame:
    """(source_id, frame_idx, samples): chunks(source_id, seq, samples) of any length cut to frames; the rest waits for the next chunk."""

    def step(state, row, out):
        rest, n = list(state[0]) + list(row[0]), state[1]
        k = len(rest) // size
        out += [(n + i, rest[i * size : (i + 1) * size]) for i in range(k)]
        return rest[k * size :], n + k

    return in_sequence(chunks, "seq", ["samples"], ([], 0), step, "source_id long, frame_idx long, samples array<double>")


def coalesce_stream(utterances: DataFrame, window: float = 5.0, cell_ms: int = 1000) -> DataFrame:
    """Short utterances merged into the next within the window; one that waits longer leaves when the watermark passes its end and the window.

    utterances(source_id, turn, text, start_time, end_time, confidence, language, ts) with a watermark on ts, the row's
    start on the event clock: whatever comes later starts later, so no utterance leaves before one that it would merge with.
    """
    fields = [*UTTERANCE, "merged"]

    def emit(rows, out):
        out += [tuple(r[c] for c in fields) for r in rows]

    def held_of(state):
        return dict(zip(fields, state, strict=True)) if state[-1] else None

    def step(state, row, out):
        new = dict(zip(UTTERANCE, row[1:], strict=True)) | {"language": row[-1] or None, "merged": 1}
        held, done = push(held_of(state), new, window)
        emit(done, out)
        return tuple(held[c] for c in fields) if held else none

    def due(state):
        return ceil(state[fields.index("end_time")] * 1000) + int(window * 1000) if state[-1] else None

    def expire(state, out):
        emit([held_of(state)], out)
        return none

    none = ("", 0.0, 0.0, 0.0, None, 0)
    kinds = ["turn", *UTTERANCE]
    row = "text string, start_time double, end_time double, confidence double, language string, merged int"
    timed = Timed("source_id", "ts", ["start_time", "turn"], kinds, none, step, due, expire, ["source_id", *fields], cell_ms)
    u = utterances.withColumn("language", F.coalesce("language", F.lit(""))).select("source_id", "ts", *kinds)
    return grouped(u, "source_id", TOGETHER).transformWithStateInPandas(timed, f"source_id long, {row}", "Append", "EventTime")


@contextmanager
def _state_in_rocks(spark: SparkSession) -> Iterator[None]:
    """State kept by RocksDB, which the processors need, for queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def run_counted(stream: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """(rows, late rows dropped, micro-batches) of a stream over what its source holds now, written as Parquet to shared storage."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    with _state_in_rocks(spark):
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    progress = q.recentProgress
    late = sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
    return spark.read.schema(stream.schema).parquet(path), late, len({p.batchId for p in progress if p.numInputRows})


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """The rows of a stream over what its source holds now."""
    return run_counted(stream, name)[0]


def each_batch(stream: DataFrame, path: str, on_result: Callable[[DataFrame, int], None], on_interim: Callable[[DataFrame, int], None] | None = None, on_settled: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream (is_final, ...) over what is there: each batch is computed once, and its provisional rows, its results and its settled rows go to their callbacks, in this order.

    A batch that fails between two callbacks is handed out again under its number, with the same rows; callbacks
    that write by that number (``overwrite_epoch``) so leave no duplicate.
    """

    def all_of(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            if on_interim:
                on_interim(batch.filter("not is_final"), epoch)
            on_result(batch.filter("is_final"), epoch)
            if on_settled:
                on_settled(batch.filter("is_final"), epoch)
        finally:
            batch.unpersist()

    with _state_in_rocks(stream.sparkSession):
        q = stream.writeStream.foreachBatch(all_of).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        q.awaitTermination()


def overwrite_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    """A batch's rows as the partition of its number: written again, they replace what a failed attempt left."""
    rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def stream_of(spark: SparkSession, df: DataFrame, name: str, batches: int = 1, by: list[str | Column] | None = None) -> DataFrame:
    """df's rows as a file stream of so many micro-batches, dealt by the hash of ``by``, so a source's rows come in all of them and in no order."""
    path = scratch_path(spark, name)
    (df.repartition(batches, *by) if by else df.coalesce(batches)).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def slices_of(spark: SparkSession, df: DataFrame, name: str, batch: Column, batches: int) -> DataFrame:
    """df's rows as a file stream whose micro-batches come in the order of ``batch`` (0 to batches - 1)."""
    path = scratch_path(spark, name)
    numbered = materialise(df.withColumn("__batch", batch.cast("int")).repartition("__batch"), f"{name}-slices")
    for i in range(batches):
        numbered.filter(F.col("__batch") == i).drop("__batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
