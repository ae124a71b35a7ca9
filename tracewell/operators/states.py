"""Batch replays of the alert state machines and the rules around alerts and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import (
    DismissalRules,
    EscalationRules,
    GeofenceRules,
    GroupRules,
    PdrRules,
)
from tracewell.functions import geo
from tracewell.functions.automaton import run_machine
from tracewell.functions.scan import (
    last_seen,
    ordered_scan,
    previous,
    running_sum,
    seen_before,
    time_chunk,
)
from tracewell.operators import machines as m
from tracewell.operators.decision import TIERS, lead_time, polling_tier
from tracewell.operators.zones import with_zone_distances
from tracewell.session import store

ORDER = ["t_us", "event_id"]
HOUR = 3600


def _bits(*flags: tuple[Column, int]) -> Column:
    return sum((F.when(F.coalesce(f, F.lit(False)), b).otherwise(0) for f, b in flags), F.lit(0))


def _hourly() -> Column:
    return time_chunk("t_us", HOUR)


# --- dead-reckoning tier --------------------------------------------------------------------


def pdr_tiers(readings: DataFrame, rules: PdrRules = PdrRules()) -> DataFrame:
    """Displacement tier with hysteresis after every degraded reading of a user."""
    d = F.col("net_displacement_m")
    passed = (
        (d >= rules.down_to_indoor_m).cast("int")
        + (d > rules.up_to_transition_m).cast("int")
        + (d >= rules.down_to_transition_m).cast("int")
        + (d > rules.up_to_untracked_m).cast("int")
    )
    out = run_machine(
        readings.where("is_degraded"), ["user_id"], ORDER, _hourly(), passed, m.pdr_machine()
    )
    return out.withColumnRenamed("state_after", "pdr_tier").drop("state_before")


def stateless_pdr(displacement: Column) -> Column:
    """The plain form without hysteresis: 25 m and 50 m."""
    return (
        F.when(displacement > 50, m.PDR_TIERS[2]).when(displacement > 25, m.PDR_TIERS[1]).otherwise(m.PDR_TIERS[0])
    )


# --- geofence -------------------------------------------------------------------------------


def zone_readings(readings: DataFrame, zones: DataFrame, rules: GeofenceRules = GeofenceRules()) -> DataFrame:
    """One row per reading and zone of its user with the machine's input."""
    hourly = readings.withColumn("_chunk", _hourly())
    d = with_zone_distances(hourly, zones, ("user_id", "_chunk"))
    # An inner explode would have its filter pushed below the shuffle, where distances are computed once more.
    rows = d.select("*", F.explode_outer("zone_distances").alias("_z")).where(F.col("_z").isNotNull())
    near = F.exists("zone_distances", lambda z: z["distance"] <= 0)
    buffer = F.greatest(
        F.lit(rules.buffer_m), F.least(F.col("accuracy_m"), F.lit(rules.buffer_cap_m))
    )
    dist = F.col("_z.distance")
    hold = F.col("is_degraded") | (F.col("accuracy_m") > rules.max_accuracy_m)
    return rows.withColumns({
        "zone_id": F.col("_z.zone_id"),
        "distance_m": dist,
        "input": _bits((dist <= 0, m.INSIDE), (dist > buffer, m.PAST_BUFFER), (near, m.ANY_INSIDE), (hold, m.HOLD)),
    }).drop("_z", "zone_distances")


def geofence_states(readings: DataFrame, zones: DataFrame, rules: GeofenceRules = GeofenceRules()) -> DataFrame:
    """Boundary state, alert action and evaluation status per reading and zone."""
    # The replay looks at its input twice, to lay it out and to walk it; distances are found once.
    rows = store(zone_readings(readings, zones, rules))
    ran = run_machine(
        rows, ["user_id", "zone_id"], ORDER, F.col("_chunk"), F.col("input"), m.geofence_machine(rules)
    )
    held = F.col("input").bitwiseAND(m.HOLD) > 0
    was, now = F.col("state_before").isin(*m.OPEN_BREACH), F.col("state_after").isin(*m.OPEN_BREACH)
    breached = F.col("state_after") == "BREACHED"
    action = (
        F.when(held, "NONE")
        .when(~was & now, "ALERT_TRIGGERED")
        .when(was & ~now, "ALERT_RESOLVED")
        .when(breached, "ALERT_UPDATED")
        .otherwise("NONE")
    )
    status = F.when(held, "INSUFFICIENT_GPS").when(breached, "BREACH_ACTIVE").otherwise("NORMAL")
    return ran.withColumns({
        "state": F.col("state_after"), "action": action, "status": status,
        "distance_m": F.round("distance_m", 1),
    }).drop("state_before", "state_after", "input")


def alert_log(transitions: DataFrame, keys: Sequence[str], tier: Column | int) -> DataFrame:
    """Alerts from a stream of actions: opened, last seen, resolved, highest tier."""
    keys = list(keys)
    touched = transitions.where("action <> 'NONE'").withColumn(
        "_tier", tier if isinstance(tier, Column) else F.lit(tier)
    )
    numbered = ordered_scan(
        touched,
        keys,
        ORDER,
        time_chunk("t_us", 86_400),
        {"alert_no": running_sum(F.when(F.col("action") == "ALERT_TRIGGERED", 1).otherwise(0))},
    )
    resolved = F.max(F.when(F.col("action") == "ALERT_RESOLVED", F.col("t_us")))
    return numbered.groupBy(*keys, "alert_no").agg(
        F.min("t_us").alias("opened_us"),
        F.max("t_us").alias("updated_us"),
        F.max("_tier").alias("alert_tier"),
        F.when(resolved.isNotNull(), "AUTO_RESOLVED").otherwise("PENDING").alias("status"),
    )


# --- loops ----------------------------------------------------------------------------------


def loop_alerts(readings: DataFrame) -> DataFrame:
    """Life of loop alerts.

    Needs ``is_looping, pattern, is_corroborating_risk, inside_zone`` and ``closed`` (someone
    closed the open alert since the reading before).
    """
    release = F.col("inside_zone") | (F.col("pattern") == "PROGRESSIVE_TRANSIT")
    symbol = _bits(
        (F.col("is_looping"), m.LOOPING), (F.col("is_corroborating_risk"), m.CORROBORATED),
        (release, m.RELEASE), (F.col("closed"), m.CLOSED),
    )
    ran = run_machine(readings, ["user_id"], ORDER, _hourly(), symbol, m.loop_machine())
    was, now = F.col("state_before"), F.col("state_after")
    shut = was.endswith("_CLOSED") | F.col("closed")
    action = (
        F.when(F.col("is_looping") & ((was == "NONE") | shut), "ALERT_TRIGGERED")
        .when(F.col("is_looping"), "ALERT_UPDATED")
        .when((was != "NONE") & (now == "NONE") & ~shut, "ALERT_RESOLVED")
        .otherwise("NONE")
    )
    return ran.withColumns({
        "action": action,
        "alert_open": now != "NONE",
        "alert_tier": F.when(now.startswith("OPEN_T3"), 3).when(now.startswith("OPEN_T2"), 2),
    }).drop("state_before", "state_after")


# --- group ----------------------------------------------------------------------------------


def group_states(readings: DataFrame, rules: GroupRules = GroupRules()) -> DataFrame:
    """Separation status of patient and companion.

    Needs ``distance_m`` (null without a companion fix), ``companion_age_s``, ``accuracy_m``,
    ``companion_accuracy_m``, ``is_degraded``, ``is_aroused`` and ``closed``.
    """
    missing = F.col("distance_m").isNull() | (F.col("companion_age_s") > rules.max_age_s)
    poor = F.col("is_degraded") | (F.col("accuracy_m") > rules.max_accuracy_m)
    poor_companion = F.coalesce(F.col("companion_accuracy_m"), F.lit(5.0)) > rules.max_accuracy_m
    problem = (
        F.when(poor, "INSUFFICIENT_GPS")
        .when(missing, "ACCOMPANIMENT_UNVERIFIED")
        .when(poor_companion, "INSUFFICIENT_GPS")
    )
    rows = readings.withColumn("_problem", problem)
    held = F.col("_problem").isNotNull()
    symbol = _bits(
        (F.col("distance_m") > rules.separation_m, m.APART), (F.col("is_aroused"), m.AROUSED),
        (F.col("closed"), m.CLOSED), (held, m.GROUP_HOLD),
    )
    ran = run_machine(rows, ["user_id"], ORDER, _hourly(), symbol, m.group_machine(rules))
    before, after = F.split("state_before", r"\|"), F.split("state_after", r"\|")
    alert, old = after[1], before[1]
    live = old.isin("t2", "t3") & ~F.col("closed")
    apart = after[0] == "SEPARATED"
    action = (
        F.when(held, "NONE")
        .when(apart & live, "ALERT_UPDATED")
        .when(apart, "ALERT_TRIGGERED")
        .when((after[0] == "WITH_COMPANION") & live, "ALERT_RESOLVED")
        .otherwise("NONE")
    )
    return ran.withColumns({
        "status": F.coalesce("_problem", after[0]),
        "action": action,
        "alert_tier": F.when(alert == "t3", 3).when(alert == "t2", 2),
    }).drop("_problem", "state_before", "state_after")


def group_ticks(positions: DataFrame, rules: GroupRules = GroupRules()) -> DataFrame:
    """Separation ticks of a group.

    ``positions`` has ``group_id, tick, user_id, is_patient, latitude, longitude``; a group has a
    handful of members per tick, which are compared inside one small array.
    """
    member = F.struct("latitude", "longitude")
    per_tick = positions.groupBy("group_id", "tick").agg(
        F.max(F.when(F.col("is_patient"), member)).alias("_p"), F.collect_list(member).alias("_all")
    )
    far = lambda a, b: geo.haversine(a["latitude"], a["longitude"], b["latitude"], b["longitude"])
    lead = F.array_max(F.transform("_all", lambda a: far(F.col("_p"), a)))
    pair = F.array_max(
        F.transform("_all", lambda a: F.array_max(F.transform(F.col("_all"), lambda b: far(a, b))))
    )
    t = per_tick.select(
        "group_id", "tick", lead.alias("max_distance_m"), pair.alias("max_pairwise_m")
    ).withColumn("is_separated", F.col("max_distance_m") > rules.separation_m)
    chunk = F.floor(F.col("tick") / 4096).cast("bigint")
    lanes = {
        "_n": running_sum(F.lit(1)),
    }
    counted = ordered_scan(t, ["group_id"], ["tick"], chunk, lanes)
    streaks = ordered_scan(
        counted, ["group_id"], ["tick"], chunk,
        {"_break": last_seen(F.when(~F.col("is_separated"), F.col("_n")))},
    ).withColumn("separation_ticks", F.when(F.col("is_separated"), F.col("_n") - F.coalesce("_break", F.lit(0))).otherwise(0))
    stepped = ordered_scan(
        store(streaks.drop("_n", "_break")), ["group_id"], ["tick"], chunk, {"_was": previous(F.col("separation_ticks"))}
    )
    ticks = F.col("separation_ticks")
    level = (
        F.when(F.col("is_separated") & (ticks >= rules.alert_ticks), "ALERT")
        .when(F.col("is_separated") & (ticks >= rules.warning_ticks), "WARNING")
        .when(~F.col("is_separated") & (F.coalesce("_was", F.lit(0)) >= rules.warning_ticks), "RESOLVED")
        .otherwise("NONE")
    )
    return stepped.withColumn("alert_level", level).drop("_was")


# --- escalation -----------------------------------------------------------------------------


def escalation(readings: DataFrame, rules: EscalationRules = EscalationRules()) -> DataFrame:
    """Operational level from movement patterns and heart rate.

    Needs ``is_degraded, engine_ok, inside_zone, window_evaluated, window_id, pattern,
    confidence, is_corroborating_risk``.  Of readings of a user with the same time the first counts.
    """
    live = ~F.col("is_degraded")
    day = time_chunk("t_us", 86_400)
    # A reading with the time of the one before it is ignored.
    timed = ordered_scan(readings, ["user_id"], ORDER, day, {"_before": previous(F.col("t_us"))})
    readings = timed.where(~F.coalesce(F.col("_before") == F.col("t_us"), F.lit(False))).drop("_before")
    gaps = ordered_scan(
        readings, ["user_id"], ORDER, day, {"_seen": seen_before(F.when(live, F.col("t_us")))}
    )
    limit = int(rules.max_gap_s * 1e6)
    gap = live & F.coalesce((F.col("t_us") - F.col("_seen")) > limit, F.lit(False))
    usable = live & F.col("engine_ok") & ~F.col("inside_zone")
    closed = usable & F.col("window_evaluated") & F.col("window_id").isNotNull()
    strange = (
        closed & F.col("pattern").isin(*rules.patterns) & (F.col("confidence") >= rules.min_confidence)
    )
    safe = live & F.col("engine_ok") & F.col("inside_zone")
    rows = gaps.withColumns({
        "_gap": gap, "_closed": closed, "_strange": strange,
        "_safe": live & F.col("engine_ok") & F.col("inside_zone"),
    })
    looked = ordered_scan(
        rows, ["user_id"], ORDER, day,
        {"_last_w": seen_before(F.when(F.col("_closed"), F.col("window_id")))},
    )
    same = F.coalesce(F.col("_closed") & (F.col("_last_w") == F.col("window_id")), F.lit(False))
    ready = store(
        looked.withColumn("_same", same).withColumn("_hit", F.col("_strange") & ~same).drop("_last_w", "_seen")
    )
    machine = m.escalation_machine(rules)
    while True:
        # Expiry looks at the last confirming reading, and which readings confirm depends on the
        # state.  The replay is repeated until the readings it confirms are those it assumed; a
        # reading only depends on earlier ones, so that answer is the only one.
        timed = ordered_scan(
            ready, ["user_id"], ORDER, day, {"_sure": seen_before(F.when(F.col("_hit"), F.col("t_us")))}
        )
        expired = F.coalesce((F.col("t_us") - F.col("_sure")) > limit, F.lit(False))
        timed = timed.withColumn("_expired", expired).drop("_sure")
        ran = run_machine(timed, ["user_id"], ORDER, _hourly(), _escalation_input(), machine)
        before = F.split("state_before", r"\|")
        kept = ~F.col("_gap")
        stale = kept & (before[0] != "NONE") & F.col("_expired")
        repeat = kept & F.col("_same") & (before[3] == "1")
        ran = ran.withColumn("_now", F.col("_strange") & ~stale & ~repeat)
        if ran.where(F.col("_now") != F.col("_hit")).isEmpty():
            break
        ready = ran.withColumn("_hit", F.col("_now")).drop("_now", "_expired", "state_before", "state_after")
    level = F.split("state_after", r"\|")[0]
    return ran.select(
        *readings.columns,
        (level != "NONE").alias("is_escalated"),
        F.when(level == "C_HEART", "CRITICAL").when(level != "NONE", "SUSPICIOUS").alias("target_tier"),
        F.when(level == "S_PATTERN", rules.score_pattern)
        .when(level == "S_HEART", rules.score_heart)
        .when(level == "C_HEART", rules.score_heart_sustained)
        .alias("target_score"),
    )


def _escalation_input() -> Column:
    kind = (
        F.when(~F.col("engine_ok"), m.ERROR)
        .when(F.col("_safe"), m.SAFE)
        .when(~F.col("_closed"), m.QUIET)
        .when(F.col("_strange") & F.col("is_corroborating_risk"), m.ANOMALY_HEART)
        .when(F.col("_strange"), m.ANOMALY)
        .otherwise(m.ORDINARY)
    )
    return kind * 16 + _bits(
        (F.col("is_degraded"), m.DEGRADED), (F.col("_gap"), m.GAP), (F.col("_expired"), m.EXPIRED),
        (F.col("_same"), m.SAME_WINDOW),
    )


def merge_escalation(df: DataFrame) -> DataFrame:
    """Lift score, tier and polling to the escalation target; never lowers them.

    Needs ``risk_score, risk_tier, is_escalated, target_tier, target_score``.
    """
    critical = F.col("is_escalated") & (F.col("target_tier") == "CRITICAL")
    lifted = critical | (F.col("is_escalated") & F.col("risk_tier").isin(*TIERS[:2]))
    tier = F.when(critical, "CRITICAL").when(lifted, "SUSPICIOUS").otherwise(F.col("risk_tier"))
    score = F.when(lifted, F.greatest("risk_score", "target_score")).otherwise(F.col("risk_score"))
    out = df.withColumns({"merged_tier": tier, "merged_score": score})
    early = lead_time(F.col("risk_score"), F.col("risk_tier"))
    late = F.round(F.greatest(F.lit(240.0), 900.0 - (F.col("merged_score") - 65.0) * 15.0), 1)
    return out.withColumns({
        "merged_polling_tier": F.greatest(polling_tier(F.col("risk_tier")), polling_tier(F.col("merged_tier"))),
        "merged_lead_s": F.coalesce(early, F.when(F.col("is_escalated"), late)),
    })


# --- dismissals and alerts ------------------------------------------------------------------


def dismissal_windows(dismissals: DataFrame, rules: DismissalRules = DismissalRules()) -> DataFrame:
    """Start of every 30-day clock per cell (``cell, clock_us``).

    A clock starts at the first dismissal after the one before has run out.  Each round finds the
    next start of all cells with one aggregate that is combined before the shuffle, so a cell with
    most of the dismissals costs no more than others; rounds are at most the months covered.
    """
    span = rules.decay_days * 86_400_000_000
    rows = store(dismissals.select("cell", "t_us"))
    current = rows.groupBy("cell").agg(F.min("t_us").alias("clock_us"))
    found = current = store(current)
    while True:
        later = rows.join(current, "cell").where(F.col("t_us") > F.col("clock_us") + span)
        current = store(later.groupBy("cell").agg(F.min("t_us").alias("clock_us")))
        if current.isEmpty():
            return found
        found = store(found.unionByName(current))


def dismissal_quota(dismissals: DataFrame, rules: DismissalRules = DismissalRules()) -> DataFrame:
    """Whether each dismissal was allowed, the count in its clock and the cell's multiplier.

    ``dismissals`` has ``event_id, cell, t_us``.  Only the first three of a clock are ranked; the
    rank filter is applied before the shuffle.
    """
    span = rules.decay_days * 86_400_000_000
    part = lambda c: F.floor(c / span)
    clocks = dismissal_windows(dismissals, rules).withColumn(
        "_part", F.explode(F.array(part(F.col("clock_us")), part(F.col("clock_us")) + 1))
    )
    placed = dismissals.withColumn("_part", part(F.col("t_us"))).join(clocks, ["cell", "_part"]).where(
        (F.col("t_us") >= F.col("clock_us")) & (F.col("t_us") <= F.col("clock_us") + span)
    )
    placed = store(placed.drop("_part"))
    w = Window.partitionBy("cell", "clock_us").orderBy("t_us", "event_id")
    first = (
        placed.select("cell", "clock_us", "t_us", "event_id")
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= rules.max_dismissals)
        .select("event_id", "_r")
    )
    count = F.coalesce("_r", F.lit(rules.max_dismissals)).cast("bigint")
    return placed.join(first, "event_id", "left").select(
        "event_id",
        "cell",
        "t_us",
        "clock_us",
        F.col("_r").isNotNull().alias("allowed"),
        count.alias("count_in_window"),
        sensitivity(count, rules).alias("multiplier"),
    )


def sensitivity(count: Column, rules: DismissalRules = DismissalRules()) -> Column:
    """Score multiplier of a cell after ``count`` dismissals."""
    return 1.0 - F.least(F.lit(rules.floor), count * rules.step)


def deduplicated_alerts(readings: DataFrame, closings: DataFrame | None = None) -> DataFrame:
    """One alert per user, cell and episode; an episode ends when its alert is closed.

    ``readings`` are those in an alerting tier: ``user_id, cell, t_us, event_id, alert_tier``.
    ``closings`` has ``user_id, cell, t_us, event_id``.
    """
    key = ["user_id", "cell"]
    if closings is None:
        rows = readings.withColumn("episode", F.lit(0).cast("bigint"))
    else:
        marks = closings.select(*key, "t_us", "event_id", F.lit(1).alias("_close"))
        both = readings.withColumn("_close", F.lit(0)).unionByName(marks, allowMissingColumns=True)
        rows = ordered_scan(
            both, key, ORDER, time_chunk("t_us", 86_400), {"episode": running_sum(F.col("_close"))}
        ).where("_close = 0")
    last = F.struct("t_us", "event_id")
    return rows.groupBy(*key, "episode").agg(
        F.min("t_us").alias("opened_us"),
        F.max("t_us").alias("updated_us"),
        F.max_by("alert_tier", last).alias("alert_tier"),
        F.count("*").alias("readings"),
    )


def dismiss_alerts(alerts: DataFrame, dismissals: DataFrame, rules: DismissalRules = DismissalRules()) -> DataFrame:
    """Outcome of dismissing alerts: ``alerts`` has ``alert_id, cell``; ``dismissals`` has
    ``event_id, alert_id, t_us``."""
    named = dismissals.join(alerts.select("alert_id", "cell"), "alert_id", "left")
    known = named.where(F.col("cell").isNotNull())
    quota = dismissal_quota(known.select("event_id", "cell", "t_us"), rules)
    judged = named.join(quota.drop("cell", "t_us"), "event_id", "left")
    return judged.select(
        "event_id",
        "alert_id",
        F.when(F.col("cell").isNull(), "not_found")
        .when(F.col("allowed"), "dismissed")
        .otherwise("recalibration_required")
        .alias("result"),
        F.when(F.col("allowed"), "DISMISSED_SAFE").alias("alert_status"),
        F.when(F.col("allowed"), F.col("count_in_window")).alias("dismissal_count_in_window"),
        F.when(F.col("allowed"), F.col("clock_us")).alias("dismissal_decay_clock_start_us"),
        F.when(F.col("allowed"), F.col("multiplier")).alias("cell_sensitivity_multiplier"),
    )


def anomaly_trigger(windows: DataFrame, k99: int = 2, k95: int = 3) -> DataFrame:
    """Consecutive windows past the 99th (95th) percentile and whether the trigger fires.

    Needs ``user_id, trajectory_id, segment_index, window_index, bound`` with bound ``P99``,
    ``P95`` or null.  The window over a segment is bounded by its length in time.
    """
    w = Window.partitionBy("user_id", "trajectory_id", "segment_index").orderBy("window_index")
    n = F.row_number().over(w)
    rows = windows.withColumn("_n", n)
    since = lambda ok: F.col("_n") - F.coalesce(
        F.max(F.when(~F.coalesce(ok, F.lit(False)), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)
    )
    rows = rows.withColumns({
        "streak_p99": since(F.col("bound") == "P99"), "streak_p95": since(F.col("bound").isin("P95", "P99")),
    })
    fired = (F.col("streak_p99") >= k99) | (F.col("streak_p95") >= k95)
    return rows.withColumn("is_triggered", fired).drop("_n")


# --- companion sessions ---------------------------------------------------------------------


def session_states(sessions: DataFrame, now_us: Column) -> DataFrame:
    """Status of companion sessions at a time; a newer session ends the one before it.

    Needs ``session_id, patient_id, created_us, expires_us, consent`` (true, false or null) and
    ``consent_us``; optional closing time ``ended_us``.
    """
    seen = sessions.where(F.col("created_us") <= now_us).withColumn("_back", -F.col("created_us"))
    day = F.floor(F.col("_back") / 86_400_000_000).cast("bigint")
    nexted = ordered_scan(
        seen, ["patient_id"], ["_back", "session_id"], day, {"_next": previous(F.col("created_us"))}
    )
    over = F.least("_next", "ended_us")
    late = F.col("consent_us") > F.col("expires_us")
    answered = F.col("consent").isNotNull() & (F.col("consent_us") <= now_us) & ~late & (
        over.isNull() | (F.col("consent_us") < over)
    )
    expired = (now_us > F.col("expires_us")) & (over.isNull() | (over > F.col("expires_us")))
    status = (
        F.when(answered & ~F.col("consent"), "REVOKED")
        .when(expired, "EXPIRED")
        .when(over <= now_us, "ENDED")
        .when(answered & F.col("consent"), "ACTIVE")
        .otherwise("PENDING_INVITE")
    )
    return nexted.withColumn("status", status).drop("_back", "_next")


def companion_fixes(fixes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Why each companion fix is accepted or not.

    ``fixes`` has ``event_id, session_id, token, t_us`` and a position; ``sessions`` adds
    ``invite_token, consent, consent_us, ended_us, expires_us``.
    """
    wanted = sessions.select(
        "session_id", "invite_token", "consent", "consent_us", "ended_us", "expires_us"
    )
    joined = fixes.join(wanted, "session_id", "left")
    t = F.col("t_us")
    agreed = F.coalesce(F.col("consent") & (F.col("consent_us") <= t), F.lit(False))
    open_ = F.col("ended_us").isNull() | (t < F.col("ended_us"))
    verdict = (
        F.when(F.col("invite_token").isNull(), "unknown_session")
        .when(F.col("token") != F.col("invite_token"), "wrong_token")
        .when(~agreed | ~open_, "not_active")
        .when(t > F.col("expires_us"), "expired")
        .otherwise("accepted")
    )
    return joined.withColumn("verdict", verdict).drop(
        "invite_token", "consent", "consent_us", "ended_us", "expires_us"
    )


def latest_companion_fix(judged: DataFrame) -> DataFrame:
    """Newest accepted fix per session."""
    return judged.where("verdict = 'accepted'").groupBy("session_id").agg(
        F.max_by(F.struct("t_us", "latitude", "longitude", "event_id"), F.struct("t_us", "event_id")).alias("_f")
    ).select("session_id", "_f.*")
