"""Folds over a stream whose rows arrive out of order, with ``transformWithState``.

``Sequenced`` serves rows that are numbered without gaps: what does not follow yet waits in map state, by cells of
row numbers. ``Timed`` serves rows that only a clock orders: they wait in cells of event time, and a timer releases
a cell when the watermark passes its end, after which no row of it can come.

Each call to state costs a round trip to the JVM, so sources with neighbouring numbers share a group's state
(``grouped``): a micro-batch costs a group a few calls for each cell that it touches, whatever the number of its
sources or rows. A task holds the rows that one group has in one micro-batch and in one cell, and the folds' states;
a long source is never gathered.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: State and outputs after a row: (state, row, outputs) -> state.
Step = Callable[[tuple, tuple, list], tuple]

#: Numbered rows that a cell has room for, over all sources of its group.
ROOM = 4096


def grouped(rows: DataFrame, key: str, together: int):
    """rows by groups of so many sources with neighbouring numbers."""
    return rows.withColumn("__group", F.floor(F.col(key) / together)).groupBy("__group")


def _columns(pdf: pd.DataFrame, names: list[str]) -> list[list]:
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else v  # noqa: E731  state takes no numpy values
    return [[plain(v) for v in pdf[c]] if pdf[c].dtype == object else pdf[c].tolist() for c in names]


class _Grouped(StatefulProcessor):
    """What the folds of a group keep: ``folds``, an entry for each source, and ``waiting``, the rows of each cell."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "cell long", "rows binary")
        self.folds = handle.getValueState("folds", "of binary")

    def _rows(self, pdf: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
        """(key, values of names) of each row; a null key, which pandas shows as no number, is None."""
        keys = [None if k != k else k for k in pdf[self.key].tolist()]
        return zip(keys, *_columns(pdf, names), strict=True)

    def _folds(self) -> dict:
        kept = self.folds.get()
        return pickle.loads(kept[0]) if kept else {}

    def _keep(self, folds: dict) -> None:
        self.folds.update((pickle.dumps(folds),))

    def _cell(self, cell: int):
        rows = self.waiting.getValue((cell,))
        return pickle.loads(rows[0]) if rows else None

    def _put(self, cell: int, rows) -> None:
        self.waiting.updateValue((cell,), (pickle.dumps(rows),))

    def close(self) -> None:
        pass


class Sequenced(_Grouped):
    """A fold over each key's rows in the order of a column that counts 0, 1, 2 ... without gaps.

    ``fields`` are the other columns. Rows that were folded already, or that wait (a replay of the source), go. A group
    has ``together`` sources at most; cells have the fewer row numbers.
    """

    def __init__(self, key: str, order: str, fields: list[str], start: tuple, step: Step, out: list[str], together: int = 1):
        self.key, self.order, self.fields, self.start, self.step, self.out = key, order, fields, start, step, out
        self.size = max(1, ROOM // together)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        folds, new, out = self._folds(), {}, []
        for pdf in rows:
            for k, i, *row in self._rows(pdf, [self.order, *self.fields]):
                if i >= folds.setdefault(k, (0, self.start))[0]:
                    new.setdefault(i // self.size, {}).setdefault((k, i), row)
        todo, going = list(new), {}  # going: by cell, the sources whose next row is the first of it
        heapify(todo)
        while todo:
            cell = heappop(todo)
            held, come = self._cell(cell), new.get(cell, {})
            rows_of = come | held if held else dict(come)
            for k in {k for k, _ in come} | going.pop(cell, set()):
                at, state = folds[k]
                more: list[tuple] = []
                while at // self.size == cell and (row := rows_of.pop((k, at), None)) is not None:
                    state = self.step(state, tuple(row), more)
                    at += 1
                folds[k] = (at, state)
                out += [(k, *o) for o in more]
                if at // self.size > cell:
                    if at // self.size not in new and at // self.size not in going:
                        heappush(todo, at // self.size)
                    going.setdefault(at // self.size, set()).add(k)
            if rows_of:
                if len(rows_of) != len(held or ()) or come:
                    self._put(cell, rows_of)
            elif held:
                self.waiting.removeKey((cell,))
        self._keep(folds)
        if out:
            yield pd.DataFrame(out, columns=self.out)


class Timed(_Grouped):
    """A fold over each key's rows in event time, cell by cell as the watermark passes them, with a deadline for what the fold holds.

    ``clock`` names the event time, ``order`` the columns that order rows of a cell. ``due(state)`` is the time in
    milliseconds from which ``expire(state, outputs)`` may end what is held, or None; the source's cells that begin before it come first. Rows behind the watermark
    are dropped by Spark, which counts them.
    """

    def __init__(self, key: str, clock: str, order: list[str], fields: list[str], start: tuple, step: Step, due: Callable[[tuple], int | None], expire: Callable[[tuple, list], tuple], out: list[str], cell_ms: int):
        self.key, self.clock, self.fields, self.start = key, clock, fields, start
        self.step, self.due, self.expire, self.out, self.cell_ms = step, due, expire, out, cell_ms
        self.by = [1 + fields.index(c) for c in order]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        folds, new = self._folds(), {}
        for pdf in rows:
            cells = (pdf[self.clock].astype("datetime64[us]").astype("int64") // (1000 * self.cell_ms)).tolist()
            for c, row in zip(cells, self._rows(pdf, self.fields), strict=True):
                new.setdefault(c, []).append(row)
                folds.setdefault(row[0], (self.start, set()))[1].add(c)
        for c, come in new.items():
            held = self._cell(c)
            self._put(c, [*held, *come] if held else come)
            if not held:
                self._wake((c + 1) * self.cell_ms)
        self._keep(folds)
        return iter(())

    def _wake(self, ms: int) -> None:
        """A timer that has expired once the watermark reaches ms; timers expire when it lies beyond them."""
        self.handle.registerTimer(ms - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, folds, out, changed, wake = timerValues.getCurrentWatermarkInMs(), self._folds(), [], False, None
        for c in sorted({c for _, cells in folds.values() for c in cells if (c + 1) * self.cell_ms <= now}):
            for k, *row in sorted(self._cell(c), key=lambda r: [r[i] for i in self.by]):
                more: list[tuple] = []
                state, cells = folds[k]
                folds[k] = (self.step(state, tuple(row), more), cells - {c})
                out += [(k, *o) for o in more]
            self.waiting.removeKey((c,))
            changed = True
        for k, (state, cells) in folds.items():
            due = self.due(state)
            if due is None:
                continue
            if due > now:
                wake = due if wake is None else min(wake, due)
            # a cell that waits may hold rows from before the deadline; its own timer comes back to this state
            elif not any(c * self.cell_ms <= due for c in cells):
                more = []
                folds[k] = (self.expire(state, more), cells)
                out += [(k, *o) for o in more]
                changed = True
        if wake is not None:
            self._wake(wake)
        if changed:
            self._keep(folds)
        if out:
            yield pd.DataFrame(out, columns=self.out)
