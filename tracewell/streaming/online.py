"""The online chain: one keyed handler that runs every alert machine of a user in the order of the readings, and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import EscalationRules, GeofenceRules, GroupRules, PdrRules
from tracewell.functions import geo
from tracewell.operators import cleaning, decision, states
from tracewell.operators import machines as m
from tracewell.operators.zones import with_zone_distances, zones_by_user
from tracewell.session import side_by_side, store
from tracewell.sources import sinks
from tracewell.streaming.jobs import CLOSING_USER, LATE, prepare
from tracewell.streaming.ordered import ByBuckets, OrderedProcessor, bucket
from tracewell.streaming.processors import metres

#: What the chain reads of a reading; a column that a stream lacks is null.
INPUT = {
    "latitude": "double", "longitude": "double", "accuracy_m": "double", "is_degraded": "boolean", "net_displacement_m": "double",
    "engine_ok": "boolean", "engine_inside": "boolean", "window_evaluated": "boolean", "window_id": "string", "pattern": "string",
    "confidence": "double", "is_corroborating_risk": "boolean", "is_looping": "boolean", "loop_pattern": "string",
    "is_aroused": "boolean", "loop_closed": "boolean", "group_closed": "boolean",
}
#: What it hands on to the sinks untouched.
CARRIED = {"cell": "string", "cell_multiplier": "double", "speed_mps": "double", "battery_pct": "int", "model_score": "double", "heart_rate_bpm": "int", "wear_state": "string"}
CHAIN_OUT = (
    "user_id string, event_id bigint, t_us bigint, pdr_tier string, is_escalated boolean, target_tier string, target_score double, "
    "zone_ids array<string>, zone_states array<string>, zone_actions array<string>, zone_status array<string>, "
    "loop_action string, loop_tier bigint, group_status string, group_action string, group_tier bigint, companion_m double, "
    "is_degraded boolean, " + ", ".join(f"{n} {t}" for n, t in CARRIED.items())
)


class OnlineChain(OrderedProcessor):
    """Displacement tier, escalation, geofence, loop and group machine of a user, in event-time order.

    Companion fixes come under the patient's key.  A fix goes stale ``max_age_s`` after its time: a timer then reports
    ACCOMPANIMENT_UNVERIFIED in a row without ``event_id``, once, while the group state is held.  A silent user is forgotten after
    ``lifetime_s`` and starts anew.
    """

    ROW = "t_us bigint, event_id bigint, kind int, zone_ids array<string>, zone_m array<double>, " + ", ".join(f"{n} {t}" for n, t in (INPUT | CARRIED).items())
    ORDER = ("kind", "event_id")
    MEMORY = (
        "tier int, level int, live_us bigint, before_us bigint, window_id string, sure_us bigint, loop int, party int, "
        "fix_us bigint, fix_lat double, fix_lon double, fix_accuracy double, told boolean, fence_ids array<string>, fence_now array<int>"
    )
    COLUMNS = tuple(f.split()[0] for f in CHAIN_OUT.split(", "))

    def __init__(
        self, pdr: PdrRules = PdrRules(), fence: GeofenceRules = GeofenceRules(), group: GroupRules = GroupRules(),
        escalation: EscalationRules = EscalationRules(), lifetime_s: int = 366 * 86_400,
    ):
        super().__init__(lifetime_s)
        self.pdr_rules, self.fence_rules, self.group_rules, self.rules = pdr, fence, group, escalation

    def prepare(self) -> None:
        self.pdr, self.fence = m.pdr_machine(), m.geofence_machine(self.fence_rules)
        self.loop, self.party = m.loop_machine(), m.group_machine(self.group_rules)
        self.escalation = m.escalation_machine(self.rules)
        # Looked up, as working a move out costs more than the rest of a step.
        self.pdr_to, self.fence_to, self.loop_to, self.party_to, self.escalation_to = (
            x.table() for x in (self.pdr, self.fence, self.loop, self.party, self.escalation)
        )
        self.levels = [name.split("|") for name in self.escalation.states]
        self.scores = {"S_PATTERN": self.rules.score_pattern, "S_HEART": self.rules.score_heart, "C_HEART": self.rules.score_heart_sustained}

    def start(self) -> dict:
        return super().start() | {"tier": self.pdr.start, "level": self.escalation.start, "loop": self.loop.start, "party": self.party.start, "fence": {}}

    def load(self, memory: dict) -> None:
        memory["fence"] = dict(zip(memory["fence_ids"] or [], memory["fence_now"] or []))

    def save(self, memory: dict) -> None:
        memory.update(fence_ids=list(memory["fence"]), fence_now=list(memory["fence"].values()))

    def step(self, key, s: dict, row: dict) -> list[tuple]:
        if row["kind"] == 0:
            s.update(fix_us=row["t_us"], fix_lat=row["latitude"], fix_lon=row["longitude"], fix_accuracy=row["accuracy_m"], told=False)
            return []
        pdr_tier = None
        if row["is_degraded"]:
            s["tier"] = self.pdr_to[s["tier"] * self.pdr.symbols + m.pdr_symbol(row["net_displacement_m"] or 0.0, self.pdr_rules)]
            pdr_tier = self.pdr.states[s["tier"]]
        level = self._escalate(s, row)
        fence = self._fence(s["fence"], row)
        inside = any(state == "INSIDE" for _, state, _, _ in fence)
        loop_action, loop_tier = self._loop(s, row, inside)
        status, action, tier, apart = self._group(s, row)
        target = None if level == "NONE" else "CRITICAL" if level == "C_HEART" else "SUSPICIOUS"
        zones = [list(c) for c in zip(*fence)] or [[], [], [], []]
        carried = [row[c] for c in CARRIED]
        return [(key[0], row["event_id"], row["t_us"], pdr_tier, level != "NONE", target, self.scores.get(level), *zones, loop_action, loop_tier, status, action, tier, apart, bool(row["is_degraded"]), *carried)]

    def wanted(self, s: dict) -> int | None:
        return s["fix_us"] + int(self.group_rules.max_age_s * 1e6) if s["fix_us"] is not None and not s["told"] else None

    def idle(self, key, s: dict) -> list[tuple]:
        at, s["told"] = self.wanted(s), True
        row = dict.fromkeys(self.COLUMNS) | {"user_id": key[0], "t_us": at, "group_status": "ACCOMPANIMENT_UNVERIFIED", "group_action": "NONE"}
        return [tuple(row.values())]

    def _escalate(self, s: dict, row: dict) -> str:
        now, limit = row["t_us"], int(self.rules.max_gap_s * 1e6)
        before = self.levels[s["level"]]
        if s["before_us"] == now:  # of readings with one time the first counts
            return before[0]
        s["before_us"] = now
        live = not row["is_degraded"]
        gap = live and s["live_us"] is not None and now - s["live_us"] > limit
        if live:
            s["live_us"] = now
        ok, inside = live and row["engine_ok"] is not False, bool(row["engine_inside"])
        closed = ok and not inside and bool(row["window_evaluated"]) and row["window_id"] is not None
        strange = closed and row["pattern"] in self.rules.patterns and (row["confidence"] or 0.0) >= self.rules.min_confidence
        same = closed and s["window_id"] == row["window_id"]
        if closed:
            s["window_id"] = row["window_id"]
        expired = s["sure_us"] is not None and now - s["sure_us"] > limit
        if row["engine_ok"] is False:  # null: no engine was asked
            kind = m.ERROR
        elif ok and inside:
            kind = m.SAFE
        elif not closed:
            kind = m.QUIET
        elif strange:
            kind = m.ANOMALY_HEART if row["is_corroborating_risk"] else m.ANOMALY
        else:
            kind = m.ORDINARY
        stale = not gap and before[0] != "NONE" and expired
        if strange and not stale and not (not gap and same and before[3] == "1"):
            s["sure_us"] = now
        s["level"] = self.escalation_to[s["level"] * self.escalation.symbols + m.escalation_symbol(kind, not live, gap, expired, same)]
        return self.levels[s["level"]][0]

    def _fence(self, held: dict, row: dict) -> list[tuple[str, str, str, str]]:
        rules, out = self.fence_rules, []
        ids, far = row["zone_ids"] or [], row["zone_m"] or []
        accuracy = row["accuracy_m"] or 0.0
        poor, within = bool(row["is_degraded"]) or accuracy > rules.max_accuracy_m, any(d <= 0 for d in far)
        buffer = max(rules.buffer_m, min(accuracy, rules.buffer_cap_m))
        for zone, d in zip(ids, far):
            was = held.get(zone, self.fence.start)
            symbol = (m.INSIDE if d <= 0 else 0) | (m.PAST_BUFFER if d > buffer else 0) | (m.ANY_INSIDE if within else 0) | (m.HOLD if poor else 0)
            now = held[zone] = self.fence_to[was * self.fence.symbols + symbol]
            out.append((zone, self.fence.states[now], *m.fence_report(self.fence.states[was], self.fence.states[now], poor)))
        return out

    def _loop(self, s: dict, row: dict, inside: bool) -> tuple[str, int | None]:
        looping, shut = bool(row["is_looping"]), bool(row["loop_closed"])
        release = inside or row["loop_pattern"] == "PROGRESSIVE_TRANSIT"
        was = self.loop.states[s["loop"]]
        symbol = looping * m.LOOPING | bool(row["is_corroborating_risk"]) * m.CORROBORATED | release * m.RELEASE | shut * m.CLOSED
        s["loop"] = self.loop_to[s["loop"] * self.loop.symbols + symbol]
        now = self.loop.states[s["loop"]]
        return m.loop_action(was, now, looping, shut), m.loop_tier(now)

    def _group(self, s: dict, row: dict) -> tuple[str, str, int | None, float | None]:
        rules, problem, apart = self.group_rules, None, None
        fresh = s["fix_us"] is not None and row["t_us"] - s["fix_us"] <= int(rules.max_age_s * 1e6)
        if row["is_degraded"] or (row["accuracy_m"] or 0.0) > rules.max_accuracy_m:
            problem = "INSUFFICIENT_GPS"
        elif not fresh:
            problem = "ACCOMPANIMENT_UNVERIFIED"
        elif (s["fix_accuracy"] if s["fix_accuracy"] is not None else 5.0) > rules.max_accuracy_m:
            problem = "INSUFFICIENT_GPS"
        if fresh:
            apart = metres(row["latitude"], row["longitude"], s["fix_lat"], s["fix_lon"])
        shut = bool(row["group_closed"])
        symbol = (m.APART if apart is not None and apart > rules.separation_m else 0) | (m.AROUSED if row["is_aroused"] else 0) | (m.CLOSED if shut else 0) | (m.GROUP_HOLD if problem else 0)
        was = self.party.states[s["party"]]
        s["party"] = self.party_to[s["party"] * self.party.symbols + symbol]
        now = self.party.states[s["party"]]
        action = "NONE" if problem else m.group_action(was, now, shut)
        return problem or now.split("|")[0], action, {"t2": 2, "t3": 3}.get(now.split("|")[1]), apart


def _with(frame: DataFrame, columns: dict[str, str]) -> list[Column]:
    return [(F.col(n) if n in frame.columns else F.lit(None)).cast(t).alias(n) for n, t in columns.items()]


def chain_stream(readings: DataFrame, zones: DataFrame, companions: DataFrame | None = None, multipliers: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """One row per reading with the outcome of every machine (``CHAIN_OUT``), and one per companion fix that went stale.

    ``readings`` and ``companions`` (fixes under the patient's ``user_id``) have ``user_id, event_id, event_time, t_us, latitude,
    longitude, accuracy_m``; readings have what they know of INPUT and CARRIED.  ``multipliers`` is ``cell, cell_multiplier``.
    """
    prepare(readings.sparkSession)
    # Few large files would leave cells and distances to few tasks.
    rows = readings.repartition("user_id").withColumn("cell", geo.hex_cell("latitude", "longitude"))
    if multipliers is not None:
        rows = rows.drop("cell_multiplier").join(multipliers.select("cell", "cell_multiplier"), "cell", "left")
    rows = with_zone_distances(rows, zones)
    ids, far = F.transform("zone_distances", lambda z: z["zone_id"]), F.transform("zone_distances", lambda z: z["distance"])
    timed = [F.col(c) for c in ("user_id", "event_id", "event_time", "t_us")]
    both = rows.select(*timed, F.lit(1).alias("kind"), ids.alias("zone_ids"), far.alias("zone_m"), *_with(rows, INPUT | CARRIED))
    if companions is not None:
        none = [F.lit(None).cast(t) for t in ("array<string>", "array<double>")]
        both = both.unionByName(companions.select(*timed, F.lit(0).alias("kind"), none[0].alias("zone_ids"), none[1].alias("zone_m"), *_with(companions, INPUT | CARRIED)))
    return both.withWatermark("event_time", late).withColumn("bucket", bucket()).groupBy("bucket").transformWithStateInPandas(ByBuckets(OnlineChain()), CHAIN_OUT, "Append", "EventTime").where(F.col("user_id") != CLOSING_USER)


def scored(chain: DataFrame) -> DataFrame:
    """Readings of a chain batch with score, tier and polling tier after the escalation merge."""
    base = decision.operational_score(chain.where("event_id IS NOT NULL"))
    merged = states.merge_escalation(base)
    risk = {"risk_score": "merged_score", "risk_tier": "merged_tier", "polling_tier": "merged_polling_tier", "predicted_lead_time_sec": "merged_lead_s"}
    return merged.withColumns({n: F.col(c) for n, c in risk.items()}).withColumn("polling", decision.polling_instruction(F.col("risk_tier"), F.col("battery_pct")))


def _open_alerts(history: DataFrame) -> DataFrame:
    """One PENDING alert per user and cell of readings in an alerting tier."""
    at = F.struct("t_us", "event_id")
    hot = history.where("risk_tier IN ('SUSPICIOUS', 'CRITICAL')")
    tier = F.when(F.col("risk_tier") == "SUSPICIOUS", 2).otherwise(3).cast("bigint")
    source = F.when(F.min_by("is_escalated", at), "behavioral_escalation")
    return hot.groupBy("user_id", "cell").agg(
        F.min("t_us").alias("opened_us"), F.max("t_us").alias("updated_us"), F.max("event_id").alias("event_id"), F.max_by(tier, at).alias("alert_tier"),
        F.count("*").alias("readings"), source.alias("zone_id"), F.lit("PENDING").alias("status"),
    )


def _joined_alerts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Alerts of two periods: opened by the earlier, with time and tier of the later."""
    both = old.unionByName(new)
    last, first = F.struct("updated_us", "event_id"), F.col("opened_us")
    return both.groupBy("user_id", "cell").agg(
        F.min("opened_us").alias("opened_us"), F.max("updated_us").alias("updated_us"), F.max_by("event_id", last).alias("event_id"), F.max_by("alert_tier", last).alias("alert_tier"),
        F.sum("readings").alias("readings"), F.min_by(F.struct("zone_id"), first)["zone_id"].alias("zone_id"), F.max_by("status", last).alias("status"),
    )


def ingest(stream: DataFrame, zones: DataFrame, consent: DataFrame, path: str, checkpoint: str, companions: DataFrame | None = None, multipliers: DataFrame | None = None):
    """The whole ingest as one started query: consent, then per reading displacement, cell multiplier, score, escalation, geofence,
    loop and group, then wearables, alerts per user and cell, and history.

    ``path`` receives ``events`` (machine outcomes), ``wearables`` and ``history`` (append, a repeated batch replaces itself) and
    ``alerts`` (keyed merge).
    """
    session = stream.sparkSession
    # The closing user passes as one more that agreed, so that the source is not read once more for one row.
    closing = session.range(1).selectExpr(f"'{CLOSING_USER}' AS user_id", "true AS guardian_granted", "false AS end_user_consent_applicable", "true AS end_user_granted")
    everyone = consent.select(*closing.columns).where(F.col("user_id") != CLOSING_USER).unionByName(closing)
    # Stored, as every micro-batch reads them.
    agreed, fences = side_by_side(session, lambda: store(everyone), lambda: store(zones_by_user(zones)))
    fixes = None if companions is None else cleaning.consented(companions.where(F.col("user_id") != CLOSING_USER), agreed)
    chain = chain_stream(cleaning.consented(stream, agreed), fences, fixes, multipliers)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        history = scored(batch)
        columns = ["user_id", "event_id", "t_us", "cell", "risk_score", "risk_tier", "polling_tier", "predicted_lead_time_sec", "polling", "pdr_tier", "is_escalated"]
        worn = batch.where("event_id IS NOT NULL AND heart_rate_bpm IS NOT NULL")
        sides = [
            lambda: sinks.append_batch(worn.select("user_id", "event_id", "t_us", "heart_rate_bpm", "wear_state"), batch_id, f"{path}/wearables"),
            lambda: sinks.append_batch(history.select(*columns), batch_id, f"{path}/history"),
            lambda: sinks.merge_buckets(_open_alerts(history), batch_id, f"{path}/alerts", ["user_id", "cell"], _joined_alerts),
        ]
        try:
            sinks.append_batch(batch, batch_id, f"{path}/events")  # runs the chain and keeps its rows for the others
            side_by_side(session, *sides)
        finally:
            batch.unpersist()

    return chain.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
