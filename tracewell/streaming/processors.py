"""Keyed state handlers.  They call the same transition functions as the batch replays."""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tracewell import schemas
from tracewell.config import (
    EARTH_RADIUS_M,
    GeofenceRules,
    LoopRules,
    PdrRules,
    ScoringRules,
    SegmentRules,
)
from tracewell.operators import machines as m
from tracewell.streaming.ordered import OrderedProcessor, frames, plain_column


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = (
        math.sin((p2 - p1) / 2) ** 2
        + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


class WindowBuilder(OrderedProcessor):
    """Segment-anchored windows of a user's stream, in event-time order.

    A window is emitted when a later fix of the segment falls behind its end, when the gap to the next fix ends the segment, or when
    event time has passed the gap limit.  A silent user's numbers are kept for ``lifetime_s``; after that segments start from zero.
    """

    ROW = "t_us bigint, event_id bigint, latitude double, longitude double"
    MEMORY = (
        "seg int, seg_start bigint, win int, first_us bigint, last_us bigint, n bigint, path double, "
        "lat double, lon double, sent_seg int, sent_win int, sent_id string"
    )
    COLUMNS = tuple(f.split()[0] for f in schemas.WINDOWS_OUT.split(", "))

    def __init__(self, rules: SegmentRules = SegmentRules(), lifetime_s: int = 366 * 86_400):
        super().__init__(lifetime_s)
        self.rules = rules
        self.width, self.gap = rules.window_s * 1_000_000, int(rules.max_gap_s * 1_000_000)

    def _emit(self, user: str, s: dict, full: bool) -> tuple:
        follows = s["sent_seg"] == s["seg"] and s["sent_win"] == s["win"] - 1
        s["sent_seg"], s["sent_win"] = s["seg"], s["win"]
        s["sent_id"] = f"{user}_stream_s{s['seg']:03d}_w{s['win']:04d}"
        return user, s["sent_id"], s["seg"], s["win"], s["n"], s["first_us"], s["last_us"], s["path"], full, follows

    def _closes_full(self, s: dict) -> bool:
        return s["last_us"] - s["seg_start"] == (s["win"] + 1) * self.width

    def step(self, key, s: dict, row: dict) -> list[tuple]:
        t, lat, lon, out = row["t_us"], row["latitude"], row["longitude"], []
        if s["seg"] is None or t - s["last_us"] > self.gap:
            if s["n"]:
                out.append(self._emit(key[0], s, self._closes_full(s)))
            s.update(seg=0 if s["seg"] is None else s["seg"] + 1, seg_start=t, win=0, first_us=t, last_us=t, n=1, path=0.0, lat=lat, lon=lon)
            return out
        win = (t - s["seg_start"]) // self.width
        if win > s["win"]:
            out.append(self._emit(key[0], s, True))
            s.update(win=win, first_us=t, n=1, path=0.0)
        else:
            s.update(n=s["n"] + 1, path=s["path"] + metres(s["lat"], s["lon"], lat, lon))
        s.update(last_us=t, lat=lat, lon=lon)
        return out

    def wanted(self, s: dict) -> int | None:
        return s["last_us"] + self.gap if s["n"] else None

    def idle(self, key, s: dict) -> list[tuple]:
        row = self._emit(key[0], s, self._closes_full(s))
        s["n"] = 0  # the segment number is kept, so that the next fix starts the next segment
        return [row]


class EvidenceMonitor(WindowBuilder):
    """One row per reading, from the window state: the last window closed by then, or that evidence still accumulates."""

    COLUMNS = ("user_id", "event_id", "t_us", "window_id", "open_points", "evidence_status")

    def step(self, key, s: dict, row: dict) -> list[tuple]:
        super().step(key, s, row)
        status = "WINDOW_EVALUATED" if s["sent_id"] else "INSUFFICIENT_EVIDENCE"
        return [(key[0], row["event_id"], row["t_us"], s["sent_id"], s["n"], status)]

    def idle(self, key, s: dict) -> list[tuple]:
        super().idle(key, s)
        return []


class TrailingHistory(OrderedProcessor):
    """Keeps the last 1,200 s and 500 fixes of a user and reports their extent per reading; a silent user's track is dropped."""

    ROW = "t_us bigint, event_id bigint, latitude double, longitude double"
    COLUMNS = ("user_id", "event_id", "history_points", "history_s")
    FIX = "t_us bigint, latitude double, longitude double"

    def __init__(self, rules: LoopRules = LoopRules()):
        super().__init__(rules.history_s)
        self.rules = rules

    track = None

    def variables(self) -> None:
        self.track = self.handle.getListState("track", self.FIX)

    def start(self) -> dict:
        return super().start() | {"track": deque()}

    def forget(self) -> None:
        if self.track is not None:
            self.track.clear()

    def load(self, memory: dict) -> None:
        if self.track is not None:
            memory["track"] = deque(tuple(r) for r in self.track.get() or ())

    def save(self, memory: dict) -> None:
        self.track.put(list(memory["track"]))

    def step(self, key, memory: dict, row: dict) -> list[tuple]:
        kept, oldest = memory["track"], row["t_us"] - self.rules.history_s * 1_000_000
        kept.append((row["t_us"], row["latitude"], row["longitude"]))
        while kept[0][0] < oldest or len(kept) > self.rules.history_points:
            kept.popleft()
        memory["last_us"] = row["t_us"]
        return [(key[0], row["event_id"], len(kept), (kept[-1][0] - kept[0][0]) / 1e6)]


class LatestFix(OrderedProcessor):
    """As-of join in the stream: at every patient reading the newest companion fix, if it is not older than ``max_age_s``.

    A fix with the time of a reading counts for it.  The fix is forgotten when it can serve no reading any more.
    """

    ROW = "t_us bigint, event_id bigint, is_reading boolean, latitude double, longitude double"
    ORDER = ("is_reading", "event_id")
    MEMORY = "fix_us bigint, fix_event bigint, latitude double, longitude double"
    COLUMNS = ("user_id", "event_id", "t_us", "fix_us", "fix_event", "latitude", "longitude")

    def __init__(self, max_age_s: int = 60):
        super().__init__(max_age_s)
        self.age_us = max_age_s * 1_000_000

    def step(self, key, memory: dict, row: dict) -> list[tuple]:
        if not row["is_reading"]:
            memory.update(fix_us=row["t_us"], fix_event=row["event_id"], latitude=row["latitude"], longitude=row["longitude"])
            return []
        fresh = memory["fix_us"] is not None and row["t_us"] - memory["fix_us"] <= self.age_us
        fix = tuple(memory[n] if fresh else None for n in self.names)
        return [(key[0], row["event_id"], row["t_us"], *fix)]


class UserMonitor(StatefulProcessor):
    """Displacement tier, geofence state per zone and frozen score of every user of a hash bucket, in reading order.

    The users' memories are one value, so the calls to the state store do not grow with users.
    """

    READ = {
        "user_id": "string", "t_us": "bigint", "event_id": "bigint", "accuracy_m": "double", "is_degraded": "boolean",
        "net_displacement_m": "double", "score": "double", "zone_ids": "array<string>", "zone_m": "array<double>",
    }
    COLUMNS = ("user_id", "event_id", "t_us", "zone_id", "pdr_tier", "state", "action", "status", "frozen_score")

    def __init__(
        self, pdr: PdrRules = PdrRules(), fence: GeofenceRules = GeofenceRules(), scoring: ScoringRules = ScoringRules()
    ):
        self.pdr_rules, self.fence_rules, self.scoring = pdr, fence, scoring

    def init(self, handle) -> None:
        self.pdr = m.pdr_machine()
        self.fence = m.geofence_machine(self.fence_rules)
        self.held = handle.getValueState("held", "memories binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.held.get()
        users = pickle.loads(bytes(stored[0])) if stored else {}
        taken, out = [], []
        for frame in rows:
            taken += zip(*(plain_column(frame[n], t) for n, t in self.READ.items()))
        taken.sort(key=itemgetter(0, 1, 2))
        for user, readings in groupby(taken, itemgetter(0)):
            users[user] = self._user(user, readings, users.get(user), out)
        self.held.update((pickle.dumps(users),))
        return frames(out, self.COLUMNS)

    def _user(self, user: str, readings: Iterator[tuple], held: tuple | None, out: list[tuple]) -> tuple:
        tier, last, seen, zones = held or (self.pdr.start, None, (-1, -1), {})
        for _, t_us, event_id, accuracy, degraded, moved, score, ids, far in readings:
            now = (t_us, event_id)
            if now <= seen:
                continue  # late or repeated
            seen = now
            named = None
            if degraded:
                tier = self.pdr.step(tier, m.pdr_symbol(float(moved), self.pdr_rules))
                named = self.pdr.states[tier]
            elif score is not None:
                last = float(score)
            frozen = last if last is not None else self.scoring.frozen_default
            if degraded:  # a long displacement raises the held score
                frozen = max(frozen, m.held_score_floor(float(moved)))
            poor = bool(degraded) or float(accuracy) > self.fence_rules.max_accuracy_m
            within = any(d <= 0 for d in far or ())
            buffer = max(self.fence_rules.buffer_m, min(float(accuracy), self.fence_rules.buffer_cap_m))
            if not ids:
                out.append((user, event_id, t_us, None, named, None, None, "NO_ZONES_CONFIGURED", frozen))
            for zone, d in zip(ids or (), far or ()):
                before = zones.get(zone, self.fence.start)
                symbol = (m.INSIDE if d <= 0 else 0) | (m.PAST_BUFFER if d > buffer else 0) | (m.ANY_INSIDE if within else 0) | (m.HOLD if poor else 0)
                after = zones[zone] = self.fence.step(before, symbol)
                state = self.fence.states[after]
                out.append((user, event_id, t_us, zone, named, state, *m.fence_report(self.fence.states[before], state, poor), frozen))
        return tier, last, seen, zones
