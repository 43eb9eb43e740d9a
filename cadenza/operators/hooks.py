"""Typed places for a user's models: scorer, segmenter, preprocessor, translator. No model ships here.

A model's failure is its row's value, never the job's: an exception gives its name, a result of another type
``TypeError``, one that takes longer than ``seconds`` (where given) ``timeout``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from queue import Empty, SimpleQueue

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds that a translation may take, and calls that a task leaves behind running before it makes no more.
SECONDS, ABANDONED = 10.0, 8


def _serve(inbox: SimpleQueue, outbox: SimpleQueue) -> None:
    """Makes the calls that come in, until there is none."""
    while (work := inbox.get()) is not None:
        outbox.put(_result(*work))


def _result(f: Callable, args: tuple) -> tuple[object, str | None]:
    try:
        return f(*args), None
    except Exception as e:  # noqa: BLE001  a row's failure is a value, not the job's
        return None, type(e).__name__


class Deadline:
    """Calls a model in a thread of this worker and waits so many seconds for it; None waits as long as it takes.

    One thread makes all calls, as a new one each would cost more than a short call. A call that is late is left behind with
    its thread, since threads can't be ended, and the next call gets another; after ``ABANDONED`` of them that still run,
    further calls fail with ``stalled`` at once, so a model that hangs costs a task a bounded time and number of threads.
    """

    def __init__(self, seconds: float | None):
        self.seconds, self.late, self.at_work = seconds, [], None

    def __call__(self, f: Callable, *args) -> tuple[object, str | None]:
        """(result, None) or (None, error)."""
        if self.seconds is None:
            return _result(f, args)
        self.late = [t for t in self.late if t.is_alive()]
        if len(self.late) >= ABANDONED:
            return None, "stalled"
        if self.at_work is None:
            inbox, outbox = SimpleQueue(), SimpleQueue()
            thread = threading.Thread(target=_serve, args=(inbox, outbox), daemon=True)
            thread.start()
            self.at_work = thread, inbox, outbox
        thread, inbox, outbox = self.at_work
        inbox.put((f, args))
        try:
            return outbox.get(timeout=self.seconds)
        except Empty:
            self._leave()
            self.late.append(thread)
            return None, "timeout"

    def _leave(self) -> None:
        """The thread ends after the call that it makes."""
        if self.at_work is not None:
            self.at_work[1].put(None)
            self.at_work = None

    def __del__(self):
        self._leave()


def with_scorer(segments: DataFrame, opener: Callable[[], Callable[[np.ndarray, int], tuple[str, float]]], rate: int, samples: str = "samples", seconds: float | None = None) -> DataFrame:
    """segments with text, confidence and error; ``opener`` is called once per task. A failing segment has an empty text, and so has one without samples, which is not scored."""
    schema = T.StructType([f for f in segments.schema if f.name != samples] + [T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, call = opener(), Deadline(seconds)
        for pdf in batches:
            out = []
            for a in pdf[samples]:
                if a is None:
                    out.append(("", None, None))
                    continue
                got, error = call(score, np.asarray(a), rate)
                if error is None:
                    try:
                        text, confidence = got
                        if not isinstance(text, str):
                            raise TypeError
                        out.append((text, None if confidence is None else float(confidence), None))
                        continue
                    except (TypeError, ValueError):
                        error = "TypeError"
                out.append(("", None, error))
            extra = pd.DataFrame(out, columns=["text", "confidence", "error"], index=pdf.index)
            yield pd.concat([pdf.drop(columns=samples), extra], axis=1)

    return segments.mapInPandas(run, schema)


def with_segmenter(clips: DataFrame, segment: Callable[[np.ndarray, int], list[tuple[float, float]]] | None, rate: int, samples: str = "samples", seconds: float | None = None) -> DataFrame:
    """clips with start, end and error of each segment: no row for an empty list, one whole segment where there is no segmenter, one row without times for a failure."""
    if segment is None:
        return clips.withColumns({"start": F.lit(0.0), "end": F.size(samples) / rate, "error": F.lit(None).cast("string")})

    @F.pandas_udf("array<struct<start: double, end: double, error: string>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = Deadline(seconds)

        def one(a):
            got, error = call(segment, np.asarray(a), rate)
            if error is None:
                try:
                    return [{"start": float(s), "end": float(e), "error": None} for s, e in got]
                except (TypeError, ValueError):
                    error = "TypeError"
            return [{"start": None, "end": None, "error": error}]

        for arrays in batches:
            yield arrays.map(one)

    return clips.withColumn("__s", F.explode(of(samples))).withColumns({c: F.col(f"__s.{c}") for c in ("start", "end", "error")}).drop("__s")


def with_preprocessor(clips: DataFrame, process: Callable[[np.ndarray], np.ndarray], samples: str = "samples", seconds: float | None = None) -> DataFrame:
    """clips with processed samples and error. A result that is no array, of another length or of another type of number leaves the samples null."""

    @F.pandas_udf("struct<samples: array<double>, error: string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = Deadline(seconds)

        def one(a):
            a = np.asarray(a)
            got, error = call(process, a)
            if error is None:
                if not isinstance(got, np.ndarray):
                    error = "TypeError"
                elif got.shape != a.shape:
                    error = "length changed"
                elif got.dtype != a.dtype:
                    error = "type changed"
            return (got, None) if error is None else (None, error)

        for arrays in batches:
            yield pd.DataFrame([one(a) for a in arrays], columns=["samples", "error"], index=arrays.index)

    return clips.withColumn("__p", of(samples)).withColumns({"error": F.col("__p.error"), samples: F.col("__p.samples")}).drop("__p")


def translation(text: Column, context: Column, source: str, target: str, opener: Callable[[], Callable[[str, str, str, str], str]], seconds: float | None = SECONDS) -> Column:
    """(translated, error) by a translator that also sees the texts before; both null for a null or empty text, which it isn't asked for."""

    @F.pandas_udf("struct<translated: string, error: string>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        translate, call = opener(), Deadline(seconds)

        def one(t, c):
            if not t:
                return None, None
            got, error = call(translate, t, source, target, c or "")
            if error is None and not isinstance(got, str):
                error = "TypeError"
            return (got, None) if error is None else (None, error)

        for texts, contexts in batches:
            yield pd.DataFrame([one(t, c) for t, c in zip(texts, contexts, strict=True)], columns=["translated", "error"], index=texts.index)

    return of(text, context)


def translated(text: Column, context: Column, source: str, target: str, opener: Callable[[], Callable[[str, str, str, str], str]], seconds: float | None = SECONDS) -> Column:
    """The translated text; null where it fails or takes too long."""
    return translation(text, context, source, target, opener, seconds)["translated"]
