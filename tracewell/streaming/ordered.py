"""Event-time order for keyed handlers.

Rows wait in list state until the watermark has passed them and are then handled by time, so a row that is late within the
watermark counts as if it had come in time.  What waits per key is bounded by the watermark's delay; rows that the watermark has
left behind never reach a handler.  A key that has been silent for its lifetime loses all its state.

A call into a handler and a call to the state store cost about a millisecond each, however little they carry, so users share the key
of a hash bucket (:class:`ByBuckets`): a batch costs calls per bucket, and users and rows only the work of their steps.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Rows handed to state at once.
PART = 1000
#: Keys that the users of a stream share.  It is part of a stream's state and must not change under a checkpoint.
BUCKETS = 512


def bucket(user: str = "user_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


class OrderedProcessor(StatefulProcessor):
    """``step`` gets the rows of a key one by one by ``t_us``, then ``order``; ``idle`` is told when event time passes a wanted time.

    Subclasses name the columns they read in ``ROW`` (with ``t_us bigint``), keep their state in ``memory`` (a dict; alone under a key
    its plain values are stored as one tuple of the types in ``MEMORY``) and return output rows.  ``lifetime_s`` is how long a silent key is kept.
    """

    ROW = "t_us bigint, event_id bigint"
    ORDER: tuple[str, ...] = ("event_id",)
    MEMORY = "last_us bigint"
    COLUMNS: tuple[str, ...] = ()

    def __init__(self, lifetime_s: int):
        self.lifetime_us = lifetime_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.kept = handle.getValueState("kept", f"wake_ms bigint, seen_us bigint, begun boolean, {self.MEMORY}")
        self.variables()
        self.begin()

    def begin(self) -> None:
        """What the steps need besides state."""
        self.row_names, self.row_types = zip(*(f.split() for f in self.ROW.split(", ")))
        self.at = self.row_names.index("t_us")
        self.names = [f.split()[0] for f in self.MEMORY.split(", ")]
        self.prepare()

    def variables(self) -> None:
        """More state variables of a subclass."""

    def prepare(self) -> None:
        """Machines of a subclass."""

    def start(self) -> dict:
        return dict.fromkeys(self.names)

    def step(self, key, memory: dict, row: dict) -> Iterable[tuple]:
        raise NotImplementedError

    def wanted(self, memory: dict) -> int | None:
        """The event time (microseconds) at which ``idle`` should be called if no row comes before."""
        return None

    def idle(self, key, memory: dict) -> Iterable[tuple]:
        return ()

    def load(self, memory: dict) -> None:
        """Add to stored ``memory`` what a subclass keeps in state variables of its own; called once before the steps of a batch."""

    def save(self, memory: dict) -> None:
        """Store what :meth:`load` added; called once after the steps of a batch."""

    def forget(self) -> None:
        """Clear the state variables of a subclass."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.take(r for part in rows for r in part[list(self.row_names)].itertuples(index=False))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.due(key, timerValues.getCurrentWatermarkInMs() * 1000)
        return iter([pd.DataFrame(out, columns=list(self.COLUMNS))] if out else [])

    def take(self, rows: Iterable[tuple]) -> None:
        """Let rows (the values of ``ROW``) wait and set the timer for the first."""
        first, part = None, []
        for r in rows:  # part by part: a user's whole batch is never held
            taken = tuple(_plain(v, t) for v, t in zip(r, self.row_types))
            first = taken[self.at] if first is None else min(first, taken[self.at])
            part.append(taken)
            if len(part) == PART:
                self.waiting.appendList(part)
                part = []
        if part:
            self.waiting.appendList(part)
        if first is not None:
            held = self.kept.get() or self._empty()
            at_ms = first // 1000 + 1
            if held[0] is None or at_ms < held[0]:
                if held[0] is not None:
                    self.handle.deleteTimer(held[0])
                self.handle.registerTimer(at_ms)
                self.kept.update((at_ms, *held[1:]))

    def due(self, key, passed: int) -> list[tuple]:
        """Handle what event time ``passed`` has reached.  A state variable is read once and written once, however many rows are due."""
        _, last, begun, *values = self.kept.get() or self._empty()
        waiting = [tuple(r) for r in self.waiting.get() or ()]
        due = self.in_order(r for r in waiting if r[self.at] <= passed)
        later = [r for r in waiting if r[self.at] > passed]
        memory = dict(zip(self.names, values)) if begun else None
        if memory is not None:
            self.load(memory)
        last, memory, out = self.advance(key, last, memory, due, passed)
        if not later:
            self.waiting.clear()
        elif due:
            self.waiting.put(later)
        gone = self.gone(last, passed) and not later
        wake = [min(r[self.at] for r in later) // 1000 + 1] if later else []
        if not gone and memory is not None:
            wake.append(self.wake(last, memory))
        # A timer in the past would never be found.
        at_ms = max(min(wake), passed // 1000 + 1) if wake else None
        if at_ms is not None:
            self.handle.registerTimer(at_ms)
        if gone:
            self.forget()
            self.kept.clear()
        elif memory is not None:
            self.save(memory)
            self.kept.update((at_ms, last, True, *(memory[n] for n in self.names)))
        else:
            self.kept.update((at_ms, *self._empty()[1:]))
        return out

    def in_order(self, rows: Iterable[tuple]) -> list[tuple]:
        return sorted(rows, key=itemgetter(self.at, *(self.row_names.index(c) for c in self.ORDER)))

    def advance(self, key, last: int | None, memory: dict | None, due: list[tuple], passed: int) -> tuple[int | None, dict | None, list[tuple]]:
        """Time of the last row, memory and output of a key after the rows ``due`` (in order) and the event time ``passed``."""
        out: list[tuple] = []
        for values in due:
            row = dict(zip(self.row_names, values))
            out += self._idle_until(key, memory, row["t_us"])
            if memory is not None and last is not None and row["t_us"] - last > self.lifetime_us:
                self.forget()
                memory = None
            if memory is None:
                memory = self.start()
                self.load(memory)
            out += self.step(key, memory, row)
            last = row["t_us"]
        out += self._idle_until(key, memory, passed + 1)
        return last, memory, out

    def gone(self, last: int | None, passed: int) -> bool:
        """Whether the lifetime of a key has ended."""
        return last is not None and last + self.lifetime_us < passed

    def wake(self, last: int, memory: dict) -> int:
        """When (milliseconds) a key wants to be called if no row comes before."""
        at = self.wanted(memory)
        end = last + self.lifetime_us
        return (end if at is None else min(at, end)) // 1000 + 1

    def _empty(self) -> tuple:
        return (None,) * (3 + len(self.names))

    def _idle_until(self, key, memory: dict | None, t_us: int) -> list[tuple]:
        out: list[tuple] = []
        while memory is not None and (at := self.wanted(memory)) is not None and at < t_us:
            out += self.idle(key, memory)
            if self.wanted(memory) == at:
                raise ValueError("idle must move the wanted time on")
        return out


class ByBuckets(StatefulProcessor):
    """Runs an ordered handler for all users of a hash bucket, which is the key of ``transformWithState``.

    What waits is stored in parts of ``PART`` rows and the users' memories as one value, so the calls to the state store do not grow
    with users or rows.  One timer per bucket stands at the first time that any of its users waits for.
    """

    def __init__(self, handler: OrderedProcessor):
        self.handler = handler

    def init(self, handle) -> None:
        self.handle = handle
        self.handler.begin()
        self.names, self.types = ("user_id", *self.handler.row_names), ("string", *self.handler.row_types)
        self.waiting = handle.getListState("waiting", "rows binary")
        self.users = handle.getValueState("users", "wake_ms bigint, memories binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            columns = [plain_column(frame[n], t) for n, t in zip(self.names, self.types)]
            times = columns[1 + self.handler.at]
            first = min(times) if first is None else min(first, *times)
            taken = list(zip(*columns))
            self.waiting.appendList([(pickle.dumps(taken[n:n + PART]),) for n in range(0, len(taken), PART)])
        if first is not None:
            held_ms, memories = self.users.get() or (None, None)
            at_ms = first // 1000 + 1
            if held_ms is None or at_ms < held_ms:
                if held_ms is not None:
                    self.handle.deleteTimer(held_ms)
                self.handle.registerTimer(at_ms)
                self.users.update((at_ms, memories))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return frames(self.due(timerValues.getCurrentWatermarkInMs() * 1000), self.handler.COLUMNS)

    def due(self, passed: int) -> list[tuple]:
        handler, at = self.handler, self.handler.at
        _, memories = self.users.get() or (None, None)
        users: dict = pickle.loads(bytes(memories)) if memories else {}  # user: wake, last, memory
        due: dict[str, list[tuple]] = {}
        later = []
        for (part,) in self.waiting.get() or ():
            for user, *row in pickle.loads(bytes(part)):
                if row[at] <= passed:
                    due.setdefault(user, []).append(tuple(row))
                else:
                    later.append((user, *row))
        held = {r[0] for r in later}
        for user, (wake_ms, _, _) in users.items():
            if wake_ms * 1000 <= passed:
                due.setdefault(user, [])
        out = []
        for user, rows in due.items():
            _, last, memory = users.get(user) or (None, None, None)
            last, memory, done = handler.advance((user,), last, memory, handler.in_order(rows), passed)
            out += done
            if memory is None or (handler.gone(last, passed) and user not in held):
                users.pop(user, None)
            else:  # a timer in the past would never be found
                users[user] = max(handler.wake(last, memory), passed // 1000 + 1), last, memory
        if due or not later:
            self.waiting.clear()
            for n in range(0, len(later), PART):
                self.waiting.appendList([(pickle.dumps(later[n:n + PART]),)])
        wakes = [w for w, _, _ in users.values()] + [r[1 + at] // 1000 + 1 for r in later]
        if wakes:
            self.handle.registerTimer(min(wakes))
            self.users.update((min(wakes), pickle.dumps(users)))
        else:
            self.users.clear()
        return out


def plain_column(column: pd.Series, kind: str) -> list:
    """The values of a column of one frame as plain Python values of the declared type."""
    if column.dtype != object and kind not in ("int", "bigint", "boolean"):
        return [None if v != v else v for v in column.tolist()]
    if column.dtype.kind in "iub":
        return column.tolist()
    return [_plain(v, kind) for v in column]


def frames(rows: list[tuple], columns: Iterable[str]) -> Iterator[pd.DataFrame]:
    """Output rows as frames of plain values, so that missing ones do not turn integers into doubles."""
    return (pd.DataFrame(rows[n:n + 10_000], columns=list(columns), dtype=object) for n in range(0, len(rows), 10_000))


def _plain(v, kind: str):
    """A value that state can hold: numpy values as Python ones of the declared type, missing ones as None."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return int(v) if kind in ("int", "bigint") else bool(v) if kind == "boolean" else v
