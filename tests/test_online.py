"""The keyed handlers without a cluster: batches, watermark and timers are played by a small stand-in for the state handle."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.sources import sinks
from tracewell.streaming.online import CARRIED, INPUT, OnlineChain
from tracewell.streaming.processors import EvidenceMonitor, LatestFix, TrailingHistory, WindowBuilder

S = 1_000_000


class Variable:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return iter(self.v) if isinstance(self.v, list) else self.v

    def update(self, v):
        self.v = v

    put = update

    def appendList(self, rows):
        self.v = (self.v or []) + list(rows)

    def clear(self):
        self.v = None

    def containsKey(self, k):
        return k in (self.v or {})

    def getValue(self, k):
        return self.v[k]

    def updateValue(self, k, v):
        self.v = {**(self.v or {}), k: v}


class Handle:
    def __init__(self):
        self.variables, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.variables.setdefault(name, Variable())

    getListState = getValueState

    def getMapState(self, name, key, value):
        return self.getValueState(name, value)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def play(handler, batches, columns=None, end_s=10**6):
    """Output rows as dicts; each batch is ``(watermark in seconds, rows)``, and at the end the watermark passes everything."""
    handle = Handle()
    handler.init(handle)
    out = []
    for mark, rows in [*batches, (end_s, [])]:
        if rows:
            frame = pd.DataFrame([{c: r.get(c) for c in handler.row_names} for r in rows])
            assert not list(handler.handleInputRows(("u",), iter([frame]), Clock(mark * 1000)))
        for at in sorted(t for t in handle.timers if t <= mark * 1000):
            handle.timers.discard(at)
            for frame in handler.handleExpiredTimer(("u",), Clock(mark * 1000), None):
                out += frame.astype(object).where(frame.notna(), None).to_dict("records")
    return out, handle


def fix(t, event=0, **more):
    return {"t_us": t * S, "event_id": event, "latitude": 39.9, "longitude": 116.3} | more


def test_late_rows_count_in_order_and_windows_close():
    late = [(0, [fix(0), fix(50), fix(130)]), (20, [fix(60), fix(100), fix(250)]), (200, [fix(900)])]
    in_order = [(0, [fix(t) for t in (0, 50, 60, 100, 130, 250, 900)])]
    got, handle = play(WindowBuilder(), late)
    assert got == play(WindowBuilder(), in_order)[0]
    assert [(w["segment_index"], w["window_index"], w["point_count"], w["follows_previous"]) for w in got] == [(0, 0, 4, False), (0, 1, 1, True), (0, 2, 1, True), (1, 0, 1, False)]
    status = play(EvidenceMonitor(), late)[0]
    assert [r["evidence_status"] for r in status] == ["INSUFFICIENT_EVIDENCE"] * 4 + ["WINDOW_EVALUATED"] * 3


@pytest.mark.parametrize("make, lifetime_s", [(WindowBuilder, 366 * 86_400), (TrailingHistory, 1200), (LatestFix, 60), (OnlineChain, 366 * 86_400)])
def test_state_is_gone_after_its_lifetime(make, lifetime_s):
    row = fix(5, is_reading=True, kind=1, zone_ids=["z"], zone_m=[3.0], accuracy_m=5.0)
    _, handle = play(make(), [(0, [row])], end_s=5 + lifetime_s - 1)
    assert any(v.exists() for v in handle.variables.values())
    _, handle = play(make(), [(0, [row])], end_s=6 + lifetime_s)
    assert not any(v.exists() for v in handle.variables.values()) and not handle.timers
    # and a reading that comes after it finds nothing of the past
    got, _ = play(TrailingHistory(), [(0, [fix(0), fix(1200)]), (1, [fix(2401)])])
    assert [r["history_points"] for r in got] == [1, 2, 1]


def test_latest_fix():
    rows = [fix(0, 1, is_reading=False), fix(60, 2, is_reading=True), fix(61, 3, is_reading=True), fix(70, 4, is_reading=True), fix(70, 9, is_reading=False)]
    got, _ = play(LatestFix(), [(0, rows[3:]), (0, rows[:3])])
    assert [(r["event_id"], r["fix_event"]) for r in got] == [(2, 1), (3, None), (4, 9)]


def reading(t, **more):
    base = dict.fromkeys([*INPUT, *CARRIED]) | {"is_degraded": False, "accuracy_m": 5.0, "net_displacement_m": 0.0, "zone_ids": [], "zone_m": []}
    return base | fix(t, t, kind=1) | more


def odd(t, window, **more):
    return reading(t, engine_ok=True, engine_inside=False, window_evaluated=True, window_id=window, pattern="PACING", confidence=0.9, is_corroborating_risk=False) | more


def targets(*rows):
    return [r["target_score"] for r in play(OnlineChain(), [(0, list(rows))])[0]]


def test_escalation_cases():
    assert targets(odd(0, "a"), odd(60, "b")) == [None, 65]
    assert targets(odd(0, "a"), odd(60, "a")) == [None, None]  # one window counts once
    assert targets(odd(0, "a", is_corroborating_risk=True), odd(60, "b", is_corroborating_risk=True)) == [70, 85]
    assert targets(odd(0, "a", confidence=0.74), odd(60, "b")) == [None, None]
    assert targets(odd(0, "a"), odd(60, "b"), odd(120, "c", pattern="NORMAL")) == [None, 65, None]
    assert targets(odd(0, "a"), odd(60, "b"), odd(120, None, window_evaluated=False)) == [None, 65, 65]
    assert targets(odd(0, "a"), odd(60, "b"), odd(120, "c", engine_inside=True)) == [None, 65, None]
    assert targets(odd(0, "a"), odd(60, "b"), odd(120, "c", is_degraded=True)) == [None, 65, None]
    assert targets(odd(0, "a"), odd(60, "b"), odd(241, "c")) == [None, 65, None]  # more than 180 s apart
    bad = [reading(t, engine_ok=False) for t in (70, 80, 90)]
    assert targets(odd(0, "a"), odd(60, "b"), *bad) == [None, 65, 65, 65, None]
    assert targets(odd(0, "a"), odd(60, "b"), bad[0], odd(75, "c"), bad[1], bad[2]) == [None, 65, 65, 65, 65, 65]
    assert targets(reading(0), reading(60)) == [None, None]  # no engine


def test_group_and_stale_companion():
    near, far = 39.9001, 39.9009
    fixes = [fix(t, 1000 + t, kind=0, accuracy_m=5.0) for t in (0, 40, 80)]
    rows = [reading(t, latitude=lat) for t, lat in ((1, near), (41, far), (50, far), (81, far), (82, near), (83, near), (150, far))]
    got, _ = play(OnlineChain(), [(0, fixes + rows)])
    seen = [(r["t_us"] // S, r["group_status"], r["group_action"]) for r in got]
    assert seen == [
        (1, "WITH_COMPANION", "NONE"), (41, "SEPARATION_PENDING", "NONE"), (50, "SEPARATED", "ALERT_TRIGGERED"), (81, "SEPARATED", "ALERT_UPDATED"),
        (82, "REUNITE_PENDING", "NONE"), (83, "WITH_COMPANION", "ALERT_RESOLVED"), (140, "ACCOMPANIMENT_UNVERIFIED", "NONE"), (150, "ACCOMPANIMENT_UNVERIFIED", "NONE"),
    ]
    assert [r["event_id"] for r in got][-2] is None
    # the timer tells it even if no reading comes
    alone, _ = play(OnlineChain(), [(0, fixes)])
    assert [(r["t_us"] // S, r["group_status"]) for r in alone] == [(140, "ACCOMPANIMENT_UNVERIFIED")]


def test_geofence_releases_a_loop():
    out, back = {"zone_ids": ["z"], "zone_m": [40.0]}, {"zone_ids": ["z"], "zone_m": [-5.0]}
    rows = [reading(0, **back), reading(10, is_looping=True, **out), reading(20, is_looping=True, is_corroborating_risk=True, **out), reading(30, **back), reading(40, **back)]
    got, _ = play(OnlineChain(), [(0, rows)])
    assert [r["zone_states"][0] for r in got] == ["INSIDE", "EXIT_PENDING", "BREACHED", "REENTRY_PENDING", "INSIDE"]
    assert [r["zone_actions"][0] for r in got] == ["NONE", "NONE", "ALERT_TRIGGERED", "NONE", "ALERT_RESOLVED"]
    assert [(r["loop_action"], r["loop_tier"]) for r in got] == [("NONE", None), ("ALERT_TRIGGERED", 2), ("ALERT_UPDATED", 3), ("NONE", 3), ("ALERT_RESOLVED", None)]


def test_displacement_tier():
    moves = [(0, 30, False), (1, 30, True), (2, 53, True), (3, 47, True), (4, 22, True)]
    got, _ = play(OnlineChain(), [(0, [reading(t, net_displacement_m=float(d), is_degraded=deg) for t, d, deg in moves])])
    assert [r["pdr_tier"] for r in got] == [None, "ZONE_TRANSITION", "UNTRACKED_DISPLACEMENT", "ZONE_TRANSITION", "INDOOR_PACING"]


def test_bucketed_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    batches = [[(k, 1, k) for k in range(200)], [(3, 2, 33), (7, 0, 77)], [], [(500, 3, 5)]]
    want = {}
    for n, rows in enumerate(batches):
        for k, at, v in rows:
            if k not in want or want[k][0] <= at:
                want[k] = at, v
        df = spark.createDataFrame(rows, "k long, at long, v long")
        for _ in range(2):  # a repeated batch changes nothing
            sinks.merge_batch(df, n, path, ["k"], ["at"])
        assert {r.k: (r["at"], r.v) for r in sinks.read_merged(spark, path).collect()} == want
        data = tmp_path / "t" / "data" / f"v={n}"
        written = [p.name for p in data.iterdir() if p.name.startswith("_bucket")] if data.exists() else []
        assert len(written) <= len(rows) and (n != 1 or 1 <= len(written) <= 2)
    # only what the last two pointers name is left
    left = {(int(v.name[2:]), int(b.name[8:])) for v in (tmp_path / "t" / "data").iterdir() for b in v.iterdir() if b.name.startswith("_bucket")}
    named = set()
    for v in (tmp_path / "t" / "pointer").iterdir():
        named |= {(r.version, r.bucket) for r in spark.read.parquet(str(v)).collect()}
    assert left == named


def test_state_is_read_and_written_once_for_many_rows():
    handler, handle = TrailingHistory(), Handle()
    handler.init(handle)
    handler.handleInputRows(("u",), iter([pd.DataFrame([fix(t, t) for t in range(700)])]), Clock(0))
    calls = []
    for name in ("get", "put"):
        real = getattr(handler.track, name)
        setattr(handler.track, name, lambda *a, real=real, name=name: calls.append(name) or real(*a))
    out = [r for frame in handler.handleExpiredTimer(("u",), Clock(700_000), None) for r in frame["history_points"]]
    assert out == [min(n, 500) for n in range(1, 701)] and sorted(calls) == ["get", "put"]


def bucket_run(make, users):
    """Output per user of a handler under one bucket key, and the number of calls to the state store."""
    from tracewell.streaming.ordered import ByBuckets

    class Counted(Variable):
        calls = 0

        def __getattribute__(self, name):
            if name in ("get", "put", "update", "appendList", "clear"):
                Counted.calls += 1
            return super().__getattribute__(name)

    handler, handle, out = ByBuckets(make()), Handle(), {}
    handle.getValueState = handle.getListState = lambda name, schema: handle.variables.setdefault(name, Counted())
    handler.init(handle)
    for mark, times in ((0, (0, 40, 20)), (60, (100, 400, 90)), (400, (1900,)), (10**6, ())):
        rows = [fix(t, t) | {"user_id": u} for t in times for u in users]
        if rows:
            assert not list(handler.handleInputRows((7,), iter([pd.DataFrame(rows)]), Clock(mark * 1000)))
        if any(t <= mark * 1000 for t in handle.timers):
            handle.timers = {t for t in handle.timers if t > mark * 1000}
            for frame in handler.handleExpiredTimer((7,), Clock(mark * 1000), None):
                for row in frame.itertuples(index=False):
                    out.setdefault(row[0], []).append(tuple(row)[1:])
    return out, Counted.calls


@pytest.mark.parametrize("make", [EvidenceMonitor, TrailingHistory])
def test_users_of_a_bucket_share_the_calls_to_state(make):
    few, calls = bucket_run(make, ["u", "v"])
    many, more = bucket_run(make, ["u", *(f"w{i}" for i in range(60))])
    assert more == calls and len(many) == 61
    alone, _ = play(make(), [(0, [fix(t, t) for t in (0, 40, 20)]), (60, [fix(t, t) for t in (100, 400, 90)]), (400, [fix(1900, 1900)])])
    cut = [tuple(r.values())[1:] for r in alone]
    strip = lambda rows: [tuple(str(v).replace("w0_stream", "u_stream") for v in r) for r in rows]
    assert strip(many["u"]) == strip(few["u"]) == strip(many["w0"]) == strip(cut)


def test_moves_of_the_chain_are_looked_up():
    """A step works out no move: the tables hold them all."""
    chain = OnlineChain()
    chain.begin()
    for machine, to in ((chain.pdr, chain.pdr_to), (chain.fence, chain.fence_to), (chain.loop, chain.loop_to), (chain.party, chain.party_to), (chain.escalation, chain.escalation_to)):
        assert all(to[s * machine.symbols + x] == machine.step(s, x) for s in range(len(machine.states)) for x in range(machine.symbols))
