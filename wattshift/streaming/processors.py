"""Keyed state of the streaming operators.

Input comes packed (see ``pipeline``): one row per key and Arrow batch, with the key's clock. The clock of a stream is the
number of its newest batch and belongs to that stream alone. A window ``w`` closes when the clock reaches
``w + delay``, or at the stream's end mark. Rows of closed windows are late and dropped.

A stream that stops without an end mark has its windows closed by a timer: every key with input puts its timer ``idle``
milliseconds behind the newest arrival, and the timer that is reached closes what waits. A stream that goes on later goes on with
its next window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from wattshift.config import DetectorParams
from wattshift.operators import kernel

PART_SCHEMA = (
    "stream_id long, first_window long, last_window long, n long, sum_vi double, sum_vv double, sum_cc double, "
    "filled_n long, filled_vi double, filled_vv double, filled_cc double"
)
FEATURE_SCHEMA = "stream_id long, idx long, window_no long, f1 double, f2 double, size long"
RESULT_SCHEMA = (
    "stream_id long, s long, d boolean, event_s long, event_start long, event_end long"
)
OPEN = -(1 << 62)   # clock of a stream that has not closed anything
ENDED = 1 << 62     # clock behind the end mark
SLICE = 4096        # features judged at once for one stream; about 20 MB at w2 = 100
RELEASE = 50_000    # sorted samples handed on at once
CELLS = 1 << 18     # values (windows x slots) filled at once for one key


def _power_point(sums: np.ndarray, use_log: bool) -> np.ndarray:
    """Rows ``(n, sum_vi, sum_vv, sum_cc)`` to ``(f1, f2)``."""
    n = sums[:, 0]
    with np.errstate(invalid="ignore", divide="ignore"):
        p = sums[:, 1] / n
        s = np.sqrt(sums[:, 2] / n) * np.sqrt(sums[:, 3] / n)
        both = np.stack([p, np.sqrt(s * s - p * p)], axis=1)
        return np.log(both) if use_log else both


def _sums(v: np.ndarray, c: np.ndarray) -> tuple[int, float, float, float]:
    return len(v), float((v * c).sum()), float((v * v).sum()), float((c * c).sum())


def runs(values: np.ndarray) -> list[slice]:
    """The runs of equal values in a sorted array."""
    starts = _starts(values)
    return [slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)])]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1])))


def _by_window(windows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(windows, kind="stable")
    return windows[order], table[order]


class _Clocked(StatefulProcessor):
    """Values wait under their window until the key's clock closes it. A micro-batch adds one entry per window that stays open;
    entries are never rewritten. ``open`` counts the entries of each waiting window, so only those of due windows are read. Rows of
    windows that close at once never reach the state; they stay in arrays, with no object per window."""

    width: int                  # values of a row
    delay: int
    idle: int | None = None     # milliseconds without input after which a key closes what it holds
    by_arrival = True           # arrival times and watermark, or the clock of the machine

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "closed long")
        self.open = handle.getMapState("open", "window_no long", "entries long")
        self.waiting = handle.getMapState("waiting", "window_no long, entry long", "block binary")
        if self.idle is not None:
            self.seen = handle.getValueState("seen", "newest long, due long")

    def absorb(self, rows, windows_of, timers=None) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Store the rows of open windows; return the rows of the windows that close now as (window numbers, table of values), in
        order of windows and, in a window, of arrival, and the closed bounds before and after. windows_of turns a packed row into
        (window numbers, table of values)."""
        before = self.clock.get()[0] if self.clock.exists() else OPEN
        closed, latest, numbers, tables = before, None, [], []
        for packed in rows:
            for row in packed.itertuples(index=False):
                closed = max(closed, ENDED if row.ended else row.clock - self.delay)
                latest = row.arrived if latest is None else max(latest, row.arrived)
                windows, table = windows_of(row)
                numbers.append(windows)
                tables.append(table)
        windows, table = self._joined(numbers, tables)
        del numbers, tables
        newest = int(windows.max()) if len(windows) else OPEN
        fresh = windows > before
        now, later = fresh & (windows <= closed), fresh & (windows > closed)
        entries = self._entries()
        due = self._due(entries, closed) if closed > before else []
        due.append((windows[now], table[now]))
        windows, table = _by_window(windows[later], table[later])
        for part in runs(windows):
            window = int(windows[part.start])
            at = entries.get(window, 0)
            self.waiting.updateValue((window, at), (np.ascontiguousarray(table[part], float).tobytes(),))
            self.open.updateValue((window,), (at + 1,))
        self.clock.update((closed,))
        if self.idle is not None:
            self._put_off(newest, closed, int(latest) if self.by_arrival else timers.getCurrentProcessingTimeInMs())
        return *_by_window(*self._joined(*zip(*due))), before, closed

    def _joined(self, numbers, tables) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.empty(0, np.int64), *numbers]).astype(np.int64), np.concatenate([np.empty((0, self.width)), *tables])

    def _entries(self) -> dict[int, int]:
        """Waiting windows and the number of their entries."""
        return {window: n for (window,), (n,) in self.open.iterator()}

    def _due(self, entries: dict[int, int], closed: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Take the waiting rows of closed windows out of the state."""
        due = []
        for window in [w for w in entries if w <= closed]:
            for at in range(entries[window]):
                table = np.frombuffer(self.waiting.getValue((window, at))[0]).reshape(-1, self.width)
                due.append((np.full(len(table), window, np.int64), table))
                self.waiting.removeKey((window, at))
            self.open.removeKey((window,))
        return due

    def _put_off(self, newest: int, closed: int, now: int) -> None:
        """Move the key's one timer behind the newest input; a stream that has ended needs none."""
        known, due = self.seen.get() if self.seen.exists() else (OPEN, None)
        if due is not None:
            self.handle.deleteTimer(due)
        newest, due = max(known, newest), None
        if closed != ENDED and newest > closed:
            due = now + self.idle
            self.handle.registerTimer(due)
        self.seen.update((newest, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, due = self.seen.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        before = self.clock.get()[0]
        self.seen.update((newest, None))
        if newest > before:
            self.clock.update((newest,))
            due = self._due(self._entries(), newest)
            yield from self.released(key, *_by_window(*self._joined(*(zip(*due) if due else ((), ())))), before, newest)

    def close(self) -> None:
        pass


class WindowSums(_Clocked):
    """Closed windows of a stream from partial sums: one row per window, and with ``marks`` one without samples at the stream's end."""

    width = 4

    def __init__(self, delay: int, idle: int | None = None, by_arrival: bool = True, marks: bool = False) -> None:
        self.delay, self.idle, self.by_arrival, self.marks = delay, idle, by_arrival, marks

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self.released(key, *self.absorb(
            rows, lambda r: (np.asarray(r.window_no), np.stack([np.asarray(r.n, float), r.sum_vi, r.sum_vv, r.sum_cc], 1)), timerValues))

    def released(self, key, windows: np.ndarray, table: np.ndarray, before: int, closed: int) -> Iterator[pd.DataFrame]:
        at = _starts(windows)
        if len(at):
            sums = np.add.reduceat(table, at, axis=0)
            yield _parts(key[0], windows[at], windows[at], sums, sums)
        if self.marks and closed == ENDED and before != ENDED:
            nothing = np.zeros((1, 4))
            yield _parts(key[0], [ENDED], [ENDED], nothing, nothing)


class SlotSums(_Clocked):
    """The share of one slot group in a stream's closed windows: own sums, and sums with the last value of every slot.

    A run of windows without a sample of the group is one row. State holds the last reading per slot of the group.
    """

    width = 4   # slot in the group, batch, voltage, current

    def __init__(self, params: DetectorParams, groups: int, delay: int, idle: int | None = None, by_arrival: bool = True) -> None:
        self.w1, self.groups, self.delay, self.idle, self.by_arrival = params.w1, groups, delay, idle, by_arrival

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "readings binary, window_no long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        w1, groups = self.w1, self.groups

        def unpack(r):
            i = np.asarray(r.i, np.int64)
            return i // w1, np.stack([(i % w1) // groups, np.asarray(r.batch, float), r.voltage, r.current], 1)

        yield from self.released(key, *self.absorb(rows, unpack, timerValues))

    def released(self, key, windows: np.ndarray, table: np.ndarray, before: int, closed: int) -> Iterator[pd.DataFrame]:
        stored, at = self.last.get() if self.last.exists() else (b"", None)
        slots = -(-self.w1 // self.groups)
        held = np.frombuffer(stored).reshape(3, -1).copy() if stored else np.zeros((3, slots))
        starts = _starts(windows)
        length = max(1, CELLS // slots)     # windows in one slice
        for a in range(0, len(starts), length):
            part = slice(starts[a], starts[a + length] if a + length < len(starts) else len(windows))
            out, held = self._slice(key, windows[part], table[part], held, at)
            at = int(windows[part.stop - 1])
            yield out
        if at is not None:
            last = closed if closed != ENDED else ENDED if before != ENDED else at
            if last > at:
                yield _parts(key[0], [at + 1], [last], np.zeros((1, 4)), _held_sums(held)[None])
                at = closed if closed != ENDED else at
            self.last.update((held.tobytes(), at))

    def _slice(self, key, windows: np.ndarray, table: np.ndarray, held: np.ndarray, at: int | None):
        """Rows of a run of windows, and the last readings behind it; all windows at once, one slot per column."""
        order = np.lexsort((table[:, 3], table[:, 2], table[:, 1], windows))     # the greatest (batch, voltage, current) of a slot counts
        windows, table = windows[order], table[order]
        starts = _starts(windows)
        number = windows[starts]
        v, c = table[:, 2], table[:, 3]
        own = np.add.reduceat(np.stack([np.ones(len(v)), v * c, v * v, c * c], 1), starts, axis=0)
        row, slot = np.searchsorted(number, windows), table[:, 0].astype(int)
        source = np.full((len(number) + 1, held.shape[1]), -1)       # row of the table that a slot's value comes from; line 0: held before
        source[row + 1, slot] = np.arange(len(table))                 # the last write of a slot stays
        source = np.maximum.accumulate(source, axis=0)
        volt = np.where(source >= 0, v[source], held[1])
        amp = np.where(source >= 0, c[source], held[2])
        known = (source >= 0) | (held[0] == 1.0)
        filled = np.stack([known.sum(axis=1), *[np.where(known, x, 0.0).sum(axis=1) for x in (volt * amp, volt * volt, amp * amp)]], 1)
        previous = np.concatenate(([number[0] - 1 if at is None else at], number[:-1]))
        gaps = np.flatnonzero(number > previous + 1)
        out = _parts(
            key[0], np.concatenate((number, previous[gaps] + 1)), np.concatenate((number, number[gaps] - 1)),
            np.concatenate((own, np.zeros((len(gaps), 4)))), np.concatenate((filled[1:], filled[gaps])))
        return out.sort_values("first_window"), np.stack([known[-1].astype(float), volt[-1], amp[-1]])


def _held_sums(held: np.ndarray) -> np.ndarray:
    known = held[0] == 1.0
    return np.array(_sums(held[1, known], held[2, known]), float)


def _parts(stream: int, first, last, own: np.ndarray, filled: np.ndarray) -> pd.DataFrame:
    """Rows of ``PART_SCHEMA`` from sums ``(n, vi, vv, cc)``."""
    columns = [np.asarray(first, np.int64), np.asarray(last, np.int64), own[:, 0].astype(np.int64), *own[:, 1:].T, filled[:, 0].astype(np.int64), *filled[:, 1:].T]
    out = pd.DataFrame(dict(zip([c.split()[0] for c in PART_SCHEMA.split(", ")][1:], columns)))
    out.insert(0, "stream_id", stream)
    return out


class SignalProcessor(StatefulProcessor):
    """Closed windows of a stream to features, and on to detection results.

    All slot groups of a stream close the same windows in the same micro-batch; here their shares are added up, so memory
    is one small row per closed window. State: the feature counter, and for detection the last ``w2`` features
    with the window's start. Detection goes in slices of ``SLICE`` features, or of ``partition`` if that is more.
    """

    def __init__(self, params: DetectorParams, detect: bool, index: bool = True) -> None:
        self.params, self.detect, self.index = params, detect, index

    def init(self, handle) -> None:
        self.state = handle.getValueState("signal", "count long, start long, recent binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        windows, sums = self._add_up(rows)
        count, start, recent = self.state.get() if self.state.exists() else (0, 0, b"")
        length = max(self.params.partition, SLICE)
        for at in range(0, len(windows), length):
            part = slice(at, at + length)
            own = (sums[part, 0] >= self.params.w1) | (np.arange(count, count + len(windows[part])) == 0)
            points = _power_point(np.where(own[:, None], sums[part, :4], sums[part, 4:]), self.params.use_log)
            if self.detect:
                out, start, recent = self._detect(points, count, start, recent)
            else:
                out = pd.DataFrame({
                    "idx": np.arange(count, count + len(points)), "window_no": windows[part], "f1": points[:, 0], "f2": points[:, 1],
                    "size": np.where(own, sums[part, 0], sums[part, 4]).astype("int64"),
                })
            out.insert(0, "stream_id", key[0])
            count += len(points)
            yield out
        self.state.update((int(count), int(start), recent))

    def _add_up(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """Windows with samples, in order, and their summed shares (own four, filled four)."""
        bounds, values = [np.empty((0, 2), np.int64)], [np.empty((0, 8))]
        for packed in rows:
            bounds.append(packed[["first_window", "last_window"]].to_numpy(np.int64))
            values.append(packed.iloc[:, 3:].to_numpy(dtype=float))
        bounds, values = np.concatenate(bounds), np.concatenate(values)
        full = values[:, 0] != 0
        windows, at = np.unique(bounds[full, 0], return_inverse=True)
        sums = np.zeros((len(windows), 8))
        np.add.at(sums, at, values[full])
        # A run without samples counts in each window of it that has samples of other groups: at most once per window and group.
        empty = np.flatnonzero(~full)
        a, b = np.searchsorted(windows, bounds[empty, 0]), np.searchsorted(windows, bounds[empty, 1], "right")
        n = b - a
        at = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        np.add.at(sums, at, values[np.repeat(empty, n)])
        return windows, sums

    def _detect(self, points, count: int, start: int, stored: bytes):
        w2 = self.params.w2
        before = np.frombuffer(stored).reshape(-1, 2) if stored else np.empty((0, 2))
        pad = np.full((w2 - len(before), 2), np.nan)
        series = np.concatenate([pad, before, points])
        first, last = kernel.window_intervals(
            series[:, 0], series[:, 1], w2, self.params.eps, self.params.min_locality
        )
        moves, exits = kernel.follow_starts(first, last, w2, {start - count: 1})
        out = pd.DataFrame({"s": np.arange(count, count + len(points))})
        t, a, b = np.array([(t, a, b) for t, _, a, b, _ in moves if a is not None], np.int64).reshape(-1, 3).T
        found, starts, stops = np.zeros(len(points), bool), np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        found[t], starts[t], stops[t] = True, count + a, count + b
        out["d"] = found
        out["event_s"] = np.where(found, (starts + stops) // 2 + 1, -1)
        out["event_start"], out["event_end"] = pd.arrays.IntegerArray(starts, ~found), pd.arrays.IntegerArray(stops, ~found)
        return out, count + exits[0][0], series[-w2:][-(len(before) + len(points)):].tobytes()

    def close(self) -> None:
        pass


class EventTimeSorter(_Clocked):
    """Releases the samples of every ``groups``-th window of a stream in time order once the stream's clock has passed them.

    With ``late`` samples of windows that were closed before are released at once, marked; nothing is lost then.
    """

    width = 3   # i, voltage, current

    def __init__(self, params: DetectorParams, delay: int, late: bool = False) -> None:
        self.w1, self.delay, self.late = params.w1, delay, late

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late: list[np.ndarray] = []
        closed = self.clock.get()[0] if self.clock.exists() else OPEN

        def unpack(r):
            i = np.asarray(r.i, np.int64)
            table = np.stack([i.view(float), np.asarray(r.voltage, float), np.asarray(r.current, float)], 1)
            late.append(table[i // self.w1 <= closed])
            return i // self.w1, table

        windows, table, _, _ = self.absorb(rows, unpack)
        yield from self._sorted(key, windows, table, False)
        if self.late and late:
            table = np.concatenate(late)
            yield from self._sorted(key, np.zeros(len(table), np.int64), table, True)

    def _sorted(self, key, windows: np.ndarray, table: np.ndarray, late: bool) -> Iterator[pd.DataFrame]:
        i = np.ascontiguousarray(table[:, 0]).view(np.int64)
        order = np.lexsort((table[:, 2], table[:, 1], i, windows))
        for at in range(0, len(order), RELEASE):
            part = order[at: at + RELEASE]
            out = pd.DataFrame({"stream_id": key[0], "i": i[part], "voltage": table[part, 1], "current": table[part, 2]})
            if self.late:
                out["late"] = late
            yield out
