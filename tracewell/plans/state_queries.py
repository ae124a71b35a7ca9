"""Queries over the alert state machines; the oracles walk the readings one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import geo
from tracewell.operators import asof, states
from tracewell.plans import adapter
from tracewell.plans.context_queries import SCORE, ZONED, operational
from tracewell.plans.profile_queries import rq
from tracewell.plans.registry import query, rounded
from tracewell.plans.sqltext import BASE, READINGS, feat, hav, q
from tracewell.plans.window_queries import feature_table, hex_sql


def walk(seq: str, key: str, start: str, columns: str, step: str) -> str:
    """Recursive CTE ``rec``: one step per row of ``seq`` (numbered ``n`` per ``key``)."""
    names = ", ".join(f"s.{k.strip()}" for k in key.split(","))
    on = " AND ".join(f"s.{k.strip()} = r.{k.strip()}" for k in key.split(","))
    return f""",
seq AS ({seq}),
rec AS (
  SELECT {key}, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS event_id, {start} FROM (SELECT DISTINCT {key} FROM seq)
  UNION ALL
  SELECT {names}, s.n, s.event_id, {step} FROM rec r JOIN seq s ON {on} AND s.n = r.n + 1)"""


NUM = "row_number() OVER (PARTITION BY {key} ORDER BY t_us, event_id) AS n"
SEQ1 = f"SELECT user_id, event_id, net_displacement_m AS d, {NUM.format(key='user_id')} FROM readings WHERE is_degraded"
ST1 = READINGS + walk(SEQ1, "user_id", "0 AS s", "s", """CASE r.s WHEN 0 THEN CASE WHEN d > 27 THEN 1 ELSE 0 END
  WHEN 1 THEN CASE WHEN d > 52 THEN 2 WHEN d < 23 THEN 0 ELSE 1 END ELSE CASE WHEN d < 48 THEN 1 ELSE 2 END END""")


@query("st1_displacement_tier", rq(ST1, """SELECT event_id, user_id, CASE s WHEN 0 THEN 'INDOOR_PACING' WHEN 1 THEN 'ZONE_TRANSITION'
  ELSE 'UNTRACKED_DISPLACEMENT' END AS pdr_tier FROM rec WHERE n > 0"""))
def displacement_tier(spark, sf):
    r = adapter.readings(spark, sf).select("user_id", "event_id", "t_us", "is_degraded", "net_displacement_m")
    return states.pdr_tiers(r).select("event_id", "user_id", "pdr_tier")


@query("st1_stateless_tier", q(READINGS, """SELECT event_id, CASE WHEN net_displacement_m > 50 THEN 'UNTRACKED_DISPLACEMENT'
  WHEN net_displacement_m > 25 THEN 'ZONE_TRANSITION' ELSE 'INDOOR_PACING' END AS pdr_tier FROM readings"""))
def stateless_tier(spark, sf):
    return adapter.readings(spark, sf).select("event_id", states.stateless_pdr(F.col("net_displacement_m")).alias("pdr_tier"))


SEQ2 = f"""SELECT user_id, zone_id, event_id, d, d <= 0 AS inside, bool_or(d <= 0) OVER (PARTITION BY event_id) AS any_in,
  d > greatest(15.0, least(accuracy_m, 20.0)) AS past, is_degraded OR accuracy_m > 25 AS hold,
  {NUM.format(key='user_id, zone_id')} FROM zd JOIN readings USING (event_id)"""
INNER2 = """CASE WHEN inside THEN CASE WHEN r.st IN ('BREACHED', 'REENTRY_PENDING') AND r.ci + 1 < 2 THEN 'REENTRY_PENDING' ELSE 'INSIDE' END
  ELSE CASE r.st WHEN 'NEW' THEN 'OUTSIDE' WHEN 'INSIDE' THEN 'EXIT_PENDING'
    WHEN 'EXIT_PENDING' THEN CASE WHEN r.co + 1 >= 2 AND past THEN 'BREACHED' ELSE 'EXIT_PENDING' END
    WHEN 'REENTRY_PENDING' THEN 'BREACHED' ELSE r.st END END"""
NEXT2 = f"CASE WHEN hold THEN r.st WHEN any_in AND {INNER2} = 'BREACHED' THEN 'OUTSIDE' ELSE {INNER2} END"
ST2 = ZONED + walk(
    SEQ2, "user_id, zone_id", "'NEW' AS st, 0 AS ci, 0 AS co, false AS held, 'NEW' AS was, 0.0e0 AS d", "st, ci, co, held, was, d",
    f"{NEXT2}, CASE WHEN hold THEN r.ci WHEN inside THEN r.ci + 1 ELSE 0 END, CASE WHEN hold THEN r.co WHEN inside THEN 0 ELSE r.co + 1 END, hold, r.st, s.d",
) + """,
gf AS (SELECT *, CASE WHEN held THEN 'NONE' WHEN was NOT IN ('BREACHED', 'REENTRY_PENDING') AND st IN ('BREACHED', 'REENTRY_PENDING') THEN 'ALERT_TRIGGERED'
    WHEN was IN ('BREACHED', 'REENTRY_PENDING') AND st NOT IN ('BREACHED', 'REENTRY_PENDING') THEN 'ALERT_RESOLVED'
    WHEN st = 'BREACHED' THEN 'ALERT_UPDATED' ELSE 'NONE' END AS action,
    CASE WHEN held THEN 'INSUFFICIENT_GPS' WHEN st = 'BREACHED' THEN 'BREACH_ACTIVE' ELSE 'NORMAL' END AS status FROM rec WHERE n > 0)"""


def fence_rows(spark, sf):
    r = adapter.readings(spark, sf).select("user_id", "event_id", "t_us", "latitude", "longitude", "accuracy_m", "is_degraded")
    return states.geofence_states(r, adapter.zones(spark, sf))


@query("st2_geofence_states", rq(ST2, "SELECT event_id, zone_id, round(d, 1) + 0.0 AS distance_m, st AS state, action, status FROM gf"))
def geofence_states(spark, sf):
    return fence_rows(spark, sf).select("event_id", "zone_id", (F.col("distance_m") + 0.0).alias("distance_m"), "state", "action", "status")


@query("st2_breach_alerts", rq(ST2 + """,
al AS (SELECT g.*, t_us, sum(CASE WHEN action = 'ALERT_TRIGGERED' THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id, zone_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS no
  FROM gf g JOIN readings USING (event_id) WHERE action <> 'NONE')""", """SELECT zone_id, CAST(no AS BIGINT) AS alert_no, min(t_us) AS opened_us, max(t_us) AS updated_us,
  3 AS alert_tier, CASE WHEN bool_or(action = 'ALERT_RESOLVED') THEN 'AUTO_RESOLVED' ELSE 'PENDING' END AS status FROM al GROUP BY 1, 2"""))
def breach_alerts(spark, sf):
    log = states.alert_log(fence_rows(spark, sf), ["user_id", "zone_id"], F.lit(3).cast("bigint"))
    return log.drop("user_id")


LOOP_IN = "v % 3 = 0 AS is_looping, CASE WHEN v % 7 = 1 THEN 'PROGRESSIVE_TRANSIT' ELSE 'ORDINARY_TURN' END AS pattern, k % 4 = 0 AS is_corroborating_risk, k % 9 = 0 AS inside_zone, k % 23 = 0 AS closed"
SEQ3 = f"SELECT user_id, event_id, {LOOP_IN}, {NUM.format(key='user_id')} FROM readings"
TGT3 = "CASE WHEN is_corroborating_risk THEN 3 ELSE 2 END"
DONE3 = "(inside_zone OR pattern = 'PROGRESSIVE_TRANSIT' OR r.streak + 1 >= 2)"
ST3 = READINGS + walk(
    SEQ3, "user_id", "false AS op, false AS pend, 0 AS tier, 0 AS streak, 'NONE' AS act", "op, pend, tier, streak, act",
    f"""is_looping OR (r.op AND NOT {DONE3}),
    CASE WHEN is_looping THEN true WHEN r.op AND NOT {DONE3} THEN r.pend AND NOT closed ELSE false END,
    CASE WHEN is_looping THEN CASE WHEN r.op AND r.pend AND NOT closed THEN greatest(r.tier, {TGT3}) ELSE {TGT3} END ELSE r.tier END,
    CASE WHEN is_looping THEN 0 WHEN r.op AND NOT {DONE3} THEN r.streak + 1 ELSE 0 END,
    CASE WHEN is_looping THEN CASE WHEN r.op AND r.pend AND NOT closed THEN 'ALERT_UPDATED' ELSE 'ALERT_TRIGGERED' END
      WHEN r.op AND {DONE3} AND r.pend AND NOT closed THEN 'ALERT_RESOLVED' ELSE 'NONE' END""",
)


@query("st3_loop_alerts", rq(ST3, "SELECT event_id, act AS action, op AS alert_open, CASE WHEN op THEN tier END AS alert_tier FROM rec WHERE n > 0"))
def loop_alerts(spark, sf):
    r = adapter.readings(spark, sf).selectExpr("user_id", "event_id", "t_us", *LOOP_IN.split(", "))
    out = states.loop_alerts(r)
    return out.select("event_id", "action", "alert_open", F.col("alert_tier").cast("bigint").alias("alert_tier"))


GROUP_IN = (
    "((v % 7) - 3) * 25.0D AS off_m", "CAST(k % 70 AS DOUBLE) AS companion_age_s", "3.0D + v % 24 AS companion_accuracy_m",
    "k % 6 = 0 AS is_aroused", "k % 29 = 0 AS closed", "k % 31 = 0 AS no_fix",
)
SEQ4 = f"""SELECT user_id, event_id, abs(((v % 7) - 3) * 25.0e0) > 50 AS apart, k % 6 = 0 AS aroused, k % 29 = 0 AS closed,
  CASE WHEN is_degraded OR accuracy_m > 25 THEN 'INSUFFICIENT_GPS' WHEN k % 31 = 0 OR k % 70 > 60 THEN 'ACCOMPANIMENT_UNVERIFIED'
    WHEN 3.0 + v % 24 > 25 THEN 'INSUFFICIENT_GPS' END AS problem, {NUM.format(key='user_id')} FROM readings"""
ST4N = """CASE WHEN apart THEN CASE WHEN r.cs + 1 >= 2 THEN 'SEPARATED' ELSE 'SEPARATION_PENDING' END
  WHEN r.st IN ('SEPARATED', 'REUNITE_PENDING') AND r.cu + 1 < 2 THEN 'REUNITE_PENDING' ELSE 'WITH_COMPANION' END"""
T4 = "CASE WHEN aroused THEN 3 ELSE 2 END"
LIVE4 = "(r.tier > 0 AND r.pend AND NOT closed)"
ST4 = READINGS + walk(
    SEQ4, "user_id", "'NEW' AS st, 0 AS cs, 0 AS cu, 0 AS tier, false AS pend, 'NONE' AS act, CAST(NULL AS VARCHAR) AS problem", "",
    f"""CASE WHEN problem IS NOT NULL THEN r.st ELSE {ST4N} END,
    CASE WHEN s.problem IS NOT NULL THEN r.cs WHEN apart THEN r.cs + 1 ELSE 0 END,
    CASE WHEN s.problem IS NOT NULL THEN r.cu WHEN apart THEN 0 ELSE r.cu + 1 END,
    CASE WHEN s.problem IS NOT NULL THEN r.tier WHEN {ST4N} = 'SEPARATED' THEN CASE WHEN {LIVE4} THEN greatest(r.tier, {T4}) ELSE {T4} END
      WHEN {ST4N} = 'WITH_COMPANION' THEN 0 ELSE r.tier END,
    CASE WHEN s.problem IS NOT NULL THEN r.pend AND NOT closed WHEN {ST4N} = 'SEPARATED' THEN true WHEN {ST4N} = 'WITH_COMPANION' THEN false ELSE r.pend AND NOT closed END,
    CASE WHEN s.problem IS NOT NULL THEN 'NONE' WHEN {ST4N} = 'SEPARATED' THEN CASE WHEN {LIVE4} THEN 'ALERT_UPDATED' ELSE 'ALERT_TRIGGERED' END
      WHEN {ST4N} = 'WITH_COMPANION' AND {LIVE4} THEN 'ALERT_RESOLVED' ELSE 'NONE' END, s.problem""".replace("CASE WHEN problem IS", "CASE WHEN s.problem IS"),
)


def group_readings(spark, sf):
    r = adapter.readings(spark, sf).selectExpr("user_id", "event_id", "t_us", "accuracy_m", "is_degraded", *GROUP_IN)
    return r.withColumn("distance_m", F.when(~F.col("no_fix"), F.abs("off_m"))).drop("off_m", "no_fix")


@query("st4_group_separation", rq(ST4, "SELECT event_id, coalesce(problem, st) AS status, act AS action, CASE WHEN tier > 0 AND pend THEN tier END AS alert_tier FROM rec WHERE n > 0"))
def group_separation(spark, sf):
    g = states.group_states(group_readings(spark, sf))
    return g.select("event_id", "status", "action", F.col("alert_tier").cast("bigint").alias("alert_tier"))


ESC_IN = (
    "k % 17 <> 0 AS engine_ok", "k % 19 = 0 AS inside_zone", "k % 5 <> 0 AS window_evaluated",
    "CASE v % 6 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'RANDOM_DRIFT' ELSE 'PACING' END AS pattern",
    "0.7D + (k % 30) / 100.0D AS confidence", "v % 4 = 0 AS is_corroborating_risk",
)
SEQ5 = f"""SELECT user_id, event_id, t_us AS t, is_degraded AS deg, k % 17 <> 0 AS ok, k % 19 = 0 AS safe, k % 5 <> 0 AS ev,
  trajectory_id || '_' || (t_us // 60000000) AS w, v % 6 <> 0 AND 0.7e0 + (k % 30)/100.0e0 >= 0.75 AS odd, v % 4 = 0 AS hr,
  {NUM.format(key='user_id')} FROM readings"""
# State: count, level, errors, last window, last seen time, last confirming time.
GAP5 = "(r.seen IS NOT NULL AND s.t - r.seen > 180000000)"
C5 = f"CASE WHEN {GAP5} THEN 0 ELSE r.cnt END"
L5 = f"CASE WHEN {GAP5} THEN 0 ELSE r.lvl END"
E5 = f"CASE WHEN {GAP5} THEN 0 ELSE r.errs END"
W5 = f"CASE WHEN {GAP5} THEN NULL ELSE r.lw END"
F5 = f"CASE WHEN {GAP5} THEN NULL ELSE r.conf END"
EXP5 = f"({L5} > 0 AND {F5} IS NOT NULL AND s.t - {F5} > 180000000)"
KIND5 = f"""CASE WHEN deg THEN 'clear' WHEN {EXP5} THEN 'clear'
  WHEN NOT ok THEN CASE WHEN {L5} > 0 THEN CASE WHEN {E5} + 1 >= 3 THEN 'clear' ELSE 'error' END ELSE 'keep_err' END
  WHEN safe THEN 'clear' WHEN NOT ev OR ({W5} IS NOT NULL AND {W5} = s.w) THEN 'keep' WHEN NOT odd THEN 'clear' ELSE 'hit' END"""
ST5 = READINGS + walk(
    SEQ5, "user_id", "0 AS cnt, 0 AS lvl, 0 AS errs, CAST(NULL AS VARCHAR) AS lw, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS conf", "",
    f"""CASE {KIND5} WHEN 'clear' THEN 0 WHEN 'hit' THEN {C5} + 1 ELSE {C5} END,
    CASE {KIND5} WHEN 'clear' THEN 0 WHEN 'hit' THEN CASE WHEN hr THEN CASE WHEN {C5} + 1 >= 2 THEN 85 ELSE 70 END ELSE CASE WHEN {C5} + 1 >= 2 THEN 65 ELSE 0 END END ELSE {L5} END,
    CASE {KIND5} WHEN 'error' THEN {E5} + 1 WHEN 'keep_err' THEN {E5} ELSE 0 END,
    CASE {KIND5} WHEN 'clear' THEN NULL WHEN 'hit' THEN s.w ELSE {W5} END,
    CASE WHEN deg THEN r.seen ELSE s.t END,
    CASE {KIND5} WHEN 'clear' THEN NULL WHEN 'hit' THEN s.t ELSE {F5} END""",
)


def escalation_rows(spark, sf):
    r = adapter.readings(spark, sf).selectExpr(
        "user_id", "event_id", "t_us", "is_degraded", "concat(trajectory_id, '_', t_us div 60000000) AS window_id", *ESC_IN
    )
    return states.escalation(r)


@query("st5_behavior_escalation", rq(ST5, """SELECT event_id, lvl > 0 AS is_escalated, CASE WHEN lvl = 85 THEN 'CRITICAL' WHEN lvl > 0 THEN 'SUSPICIOUS' END AS target_tier,
  CASE WHEN lvl > 0 THEN lvl END AS target_score FROM rec WHERE n > 0"""))
def behavior_escalation(spark, sf):
    return escalation_rows(spark, sf).select("event_id", "is_escalated", "target_tier", F.col("target_score").cast("bigint").alias("target_score"))


DISMISS = BASE + """,
dm AS (SELECT event_id, CAST(uid % 20 AS VARCHAR) AS cell, 1704067200000000 + (us-1704067200000000)*5 AS t_us FROM base WHERE event_type = 'error')"""
ST6_STEP = """CASE WHEN r.clock IS NULL OR s.t_us - r.clock > 2592000000000 THEN s.t_us ELSE r.clock END,
  CASE WHEN r.clock IS NULL OR s.t_us - r.clock > 2592000000000 THEN 1 ELSE least(r.cnt + 1, 3) END,
  r.clock IS NULL OR s.t_us - r.clock > 2592000000000 OR r.cnt < 3"""
ST6 = DISMISS + walk(
    f"SELECT event_id, cell, t_us, {NUM.format(key='cell')} FROM dm", "cell",
    "CAST(NULL AS BIGINT) AS clock, 0 AS cnt, false AS allowed", "", ST6_STEP,
)


def dismissals(spark, sf):
    b = adapter.base(spark, sf).where("event_type = 'error'")
    return b.selectExpr("event_id", "CAST(uid % 20 AS STRING) AS cell", "1704067200000000 + (us-1704067200000000)*5 AS t_us")


@query("st6_dismissal_quota", rq(ST6, "SELECT event_id, cell, clock AS clock_us, allowed, cnt AS count_in_window, round(1.0e0-least(0.3e0, 0.1e0*cnt), 6) AS multiplier FROM rec WHERE n > 0"))
def dismissal_quota(spark, sf):
    return rounded(states.dismissal_quota(dismissals(spark, sf)).drop("t_us"), 6, ["multiplier"])


CELLS = SCORE + ", osx AS (" + hex_sql("*", "(SELECT os.*, r.latitude, r.longitude, r.event_type FROM os JOIN readings r USING (event_id))") + """),
alr AS (SELECT user_id, cell, t_us, event_id, CASE risk_tier WHEN 'SUSPICIOUS' THEN 2 ELSE 3 END AS alert_tier FROM osx WHERE risk_tier IN ('SUSPICIOUS', 'CRITICAL')),
cls AS (SELECT user_id, cell, t_us, event_id FROM osx WHERE event_type = 'error' AND k % 5 = 0)"""


def alert_readings(spark, sf):
    o = operational(spark, sf).withColumn("cell", geo.hex_cell("latitude", "longitude"))
    hot = o.where("risk_tier IN ('SUSPICIOUS', 'CRITICAL')").selectExpr(
        "user_id", "cell", "t_us", "event_id", "CASE risk_tier WHEN 'SUSPICIOUS' THEN 2L ELSE 3L END AS alert_tier"
    )
    return hot, o.where("event_type = 'error' AND k % 5 = 0").select("user_id", "cell", "t_us", "event_id")


@query("st7_one_alert_per_cell", q(CELLS, """SELECT user_id, cell, 0 AS episode, min(t_us) AS opened_us, max(t_us) AS updated_us, arg_max(alert_tier, (t_us, event_id)) AS alert_tier,
  count(*) AS readings FROM alr GROUP BY 1, 2"""))
def one_alert(spark, sf):
    return states.deduplicated_alerts(alert_readings(spark, sf)[0])


@query("st7_alert_episodes", q(CELLS, """SELECT user_id, cell, episode, min(t_us) AS opened_us, max(t_us) AS updated_us, arg_max(alert_tier, (t_us, event_id)) AS alert_tier, count(*) AS readings
  FROM (SELECT a.*, (SELECT count(*) FROM cls c WHERE c.user_id = a.user_id AND c.cell = a.cell AND (c.t_us, c.event_id) <= (a.t_us, a.event_id)
    AND c.event_id NOT IN (SELECT event_id FROM alr)) AS episode FROM alr a) GROUP BY 1, 2, 3"""))
def alert_episodes(spark, sf):
    # Events that alert themselves do not close anything here.
    hot, closings = alert_readings(spark, sf)
    return states.deduplicated_alerts(hot, closings.join(hot.select("event_id"), "event_id", "left_anti"))


ST8 = DISMISS + """,
dq AS (SELECT d.event_id, event_id - event_id % 7 AS alert_id, t_us FROM dm d),
alerts AS (SELECT event_id AS alert_id, CAST(uid % 20 AS VARCHAR) AS cell FROM base WHERE event_type <> 'view'),
kn AS (SELECT dq.*, cell FROM dq JOIN alerts USING (alert_id))""" + walk(
    f"SELECT event_id, cell, t_us, {NUM.format(key='cell')} FROM kn", "cell",
    "CAST(NULL AS BIGINT) AS clock, 0 AS cnt, false AS allowed", "", ST6_STEP,
)


@query("st8_dismiss_alerts", rq(ST8, """SELECT dq.event_id, dq.alert_id, CASE WHEN r.event_id IS NULL THEN 'not_found' WHEN allowed THEN 'dismissed' ELSE 'recalibration_required' END AS result,
  CASE WHEN allowed THEN 'DISMISSED_SAFE' END AS alert_status, CASE WHEN allowed THEN cnt END AS dismissal_count_in_window,
  CASE WHEN allowed THEN clock END AS dismissal_decay_clock_start_us, CASE WHEN allowed THEN round(1.0e0-least(0.3e0, 0.1e0*cnt), 6) END AS cell_sensitivity_multiplier
  FROM dq LEFT JOIN (SELECT * FROM rec WHERE n > 0) r USING (event_id)"""))
def dismiss_alerts(spark, sf):
    d = dismissals(spark, sf).selectExpr("event_id", "event_id - event_id % 7 AS alert_id", "t_us")
    alerts = adapter.base(spark, sf).where("event_type <> 'view'").selectExpr("event_id AS alert_id", "CAST(uid % 20 AS STRING) AS cell")
    return rounded(states.dismiss_alerts(alerts, d), 6, ["cell_sensitivity_multiplier"])


MERGE_IN = "k % 3 = 0 AS is_escalated, CASE WHEN k % 2 = 0 THEN 'CRITICAL' ELSE 'SUSPICIOUS' END AS target_tier"


@query("st9_merged_score", q(SCORE, f"""SELECT event_id, tier AS merged_tier, score AS merged_score,
  greatest(CASE risk_tier WHEN 'QUIESCENT' THEN 0 WHEN 'NORMAL_TRANSIT' THEN 1 WHEN 'SUSPICIOUS' THEN 2 ELSE 3 END,
    CASE tier WHEN 'QUIESCENT' THEN 0 WHEN 'NORMAL_TRANSIT' THEN 1 WHEN 'SUSPICIOUS' THEN 2 ELSE 3 END) AS merged_polling_tier,
  CASE WHEN risk_tier IN ('SUSPICIOUS', 'CRITICAL') THEN round(greatest(240.0, 900.0-(risk_score-65.0)*15.0), 1)
    WHEN is_escalated THEN round(greatest(240.0, 900.0-(score-65.0)*15.0), 1) END AS merged_lead_s FROM (
  SELECT *, CASE WHEN is_escalated AND target_tier = 'CRITICAL' THEN 'CRITICAL' WHEN is_escalated AND risk_tier IN ('QUIESCENT', 'NORMAL_TRANSIT') THEN 'SUSPICIOUS' ELSE risk_tier END AS tier,
    CASE WHEN is_escalated AND (target_tier = 'CRITICAL' OR risk_tier IN ('QUIESCENT', 'NORMAL_TRANSIT')) THEN greatest(risk_score, CASE WHEN target_tier = 'CRITICAL' THEN 85.0 ELSE 65.0 END) ELSE risk_score END AS score
  FROM (SELECT *, {MERGE_IN} FROM os))"""))
def merged_score(spark, sf):
    o = operational(spark, sf).selectExpr("event_id", "risk_score", "risk_tier", *MERGE_IN.split(", "))
    o = o.withColumn("target_score", F.expr("CASE WHEN target_tier = 'CRITICAL' THEN 85.0D ELSE 65.0D END"))
    out = states.merge_escalation(o)
    return out.select("event_id", "merged_tier", "merged_score", F.col("merged_polling_tier").cast("bigint").alias("merged_polling_tier"), "merged_lead_s")


STEP10 = "CAST((v % 7) - 3 AS DOUBLE)*0.0001e0"
TICKS = READINGS + f""",
d1 AS (SELECT uid % 30 AS group_id, event_id AS tick, {hav('latitude', 'longitude', f'latitude+{STEP10}', 'longitude')} AS a,
    {hav('latitude', 'longitude', f'latitude+2*{STEP10}', 'longitude')} AS b FROM readings),
d2 AS (SELECT *, greatest(a, b) AS mx, greatest(a, b) > 50 AS sep, row_number() OVER (PARTITION BY group_id ORDER BY tick) AS n FROM d1),
d3 AS (SELECT *, CASE WHEN sep THEN n - coalesce(max(CASE WHEN NOT sep THEN n END) OVER (PARTITION BY group_id ORDER BY tick ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS ticks FROM d2),
d4 AS (SELECT *, coalesce(lag(ticks) OVER (PARTITION BY group_id ORDER BY tick), 0) AS was FROM d3)"""


@query("st10_group_ticks", q(TICKS, """SELECT group_id, tick, round(mx, 3) AS max_distance_m, round(mx, 3) AS max_pairwise_m, sep AS is_separated, ticks AS separation_ticks,
  CASE WHEN sep AND ticks >= 4 THEN 'ALERT' WHEN sep AND ticks >= 2 THEN 'WARNING' WHEN NOT sep AND was >= 2 THEN 'RESOLVED' ELSE 'NONE' END AS alert_level FROM d4"""))
def group_ticks(spark, sf):
    member = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("j")
    r = adapter.readings(spark, sf).select("*", member)
    p = r.selectExpr(
        "uid % 30 AS group_id", "event_id AS tick", "concat(uid, '_', j) AS user_id", "j = 0 AS is_patient",
        "latitude + j * ((v % 7) - 3) * 0.0001D AS latitude", "longitude",
    )
    return rounded(states.group_ticks(p), 3, ["max_distance_m", "max_pairwise_m"])


SESSIONS = BASE + """,
ss AS (SELECT event_id AS session_id, uid AS patient_id, us AS created_us, us + (k+1)*36000000000 AS expires_us,
    CASE v % 3 WHEN 0 THEN true WHEN 1 THEN false END AS consent, us + (v % 50)*3600000000 AS consent_us,
    CASE WHEN k % 9 = 0 THEN us + 40*3600000000 END AS ended_us, 't' || (event_id % 3) AS invite_token FROM base WHERE event_type = 'signup')"""
NOW11 = 1706140800000000  # 2024-01-25


def sessions(spark, sf):
    b = adapter.base(spark, sf).where("event_type = 'signup'")
    return b.selectExpr(
        "event_id AS session_id", "uid AS patient_id", "us AS created_us", "us + (k+1)*36000000000 AS expires_us",
        "CASE v % 3 WHEN 0 THEN true WHEN 1 THEN false END AS consent", "us + (v % 50)*3600000000 AS consent_us",
        "CASE WHEN k % 9 = 0 THEN us + 40*3600000000 END AS ended_us", "concat('t', event_id % 3) AS invite_token",
    )


@query("st11_companion_sessions", q(SESSIONS, f"""SELECT session_id, CASE WHEN ans AND NOT consent THEN 'REVOKED' WHEN {NOW11} > expires_us AND (ov IS NULL OR ov > expires_us) THEN 'EXPIRED'
  WHEN ov <= {NOW11} THEN 'ENDED' WHEN ans AND consent THEN 'ACTIVE' ELSE 'PENDING_INVITE' END AS status FROM (
  SELECT *, consent IS NOT NULL AND consent_us <= {NOW11} AND consent_us <= expires_us AND (ov IS NULL OR consent_us < ov) AS ans FROM (
  SELECT *, CASE WHEN nx IS NULL THEN ended_us WHEN ended_us IS NULL THEN nx ELSE least(nx, ended_us) END AS ov FROM (
  SELECT *, lead(created_us) OVER (PARTITION BY patient_id ORDER BY created_us, session_id) AS nx FROM ss WHERE created_us <= {NOW11})))"""))
def companion_sessions(spark, sf):
    return states.session_states(sessions(spark, sf), F.lit(NOW11)).select("session_id", "status")


@query("st12_anomaly_trigger", q(feat(250), """SELECT window_id, s99 AS streak_p99, s95 AS streak_p95, s99 >= 2 OR s95 >= 3 AS is_triggered FROM (
  SELECT window_id, n - coalesce(max(CASE WHEN point_count % 3 <> 0 THEN n END) OVER w, 0) AS s99,
    n - coalesce(max(CASE WHEN point_count % 3 = 2 THEN n END) OVER w, 0) AS s95 FROM (
  SELECT *, row_number() OVER (PARTITION BY trajectory_id, segment_index ORDER BY window_index) AS n FROM feat)
  WINDOW w AS (PARTITION BY trajectory_id, segment_index ORDER BY window_index ROWS UNBOUNDED PRECEDING))"""))
def anomaly_trigger(spark, sf):
    f = feature_table(spark, sf, 250).withColumn("bound", F.expr("CASE WHEN point_count % 3 = 0 THEN 'P99' WHEN point_count % 3 = 1 THEN 'P95' END"))
    t = states.anomaly_trigger(f)
    return t.select("window_id", F.col("streak_p99").cast("bigint").alias("streak_p99"), F.col("streak_p95").cast("bigint").alias("streak_p95"), "is_triggered")


FIXES = SESSIONS + """,
fx AS (SELECT event_id, event_id - event_id % 5 AS session_id, 't' || (event_id % 4) AS token, us + (v % 9)*36000000000 AS t_us FROM base WHERE event_type = 'click'),
fv AS (SELECT fx.*, CASE WHEN invite_token IS NULL THEN 'unknown_session' WHEN token <> invite_token THEN 'wrong_token'
    WHEN NOT coalesce(consent AND consent_us <= fx.t_us, false) OR NOT (ended_us IS NULL OR fx.t_us < ended_us) THEN 'not_active'
    WHEN fx.t_us > expires_us THEN 'expired' ELSE 'accepted' END AS verdict FROM fx LEFT JOIN ss USING (session_id))"""


def fixes(spark, sf):
    p = adapter.points(spark, sf).select("event_id", "latitude", "longitude")
    b = adapter.base(spark, sf).where("event_type = 'click'").selectExpr(
        "event_id", "event_id - event_id % 5 AS session_id", "concat('t', event_id % 4) AS token", "us + (v % 9)*36000000000 AS t_us"
    )
    return states.companion_fixes(b.join(p, "event_id"), sessions(spark, sf))


@query("st13_companion_fixes", q(FIXES, "SELECT event_id, verdict FROM fv"))
def companion_fixes(spark, sf):
    return fixes(spark, sf).select("event_id", "verdict")


@query("st13_latest_companion_fix", q(FIXES, "SELECT session_id, max(t_us) AS t_us, arg_max(event_id, (t_us, event_id)) AS event_id FROM fv WHERE verdict = 'accepted' GROUP BY 1"))
def latest_fix(spark, sf):
    return states.latest_companion_fix(fixes(spark, sf)).select("session_id", "t_us", "event_id")


@query("stm8_latest_fix_as_of", q(READINGS, """SELECT l.event_id, CASE WHEN (l.t_us-r.t_us)/1e6 <= 60 THEN r.event_id END AS fix_event,
  round((l.t_us-r.t_us)/1e6, 6) AS age_s FROM readings l LEFT JOIN LATERAL (SELECT t_us, event_id FROM readings x WHERE x.user_id = l.user_id AND x.event_type = 'view'
  AND x.t_us <= l.t_us ORDER BY t_us DESC, event_id DESC LIMIT 1) r ON true WHERE l.event_type = 'click'"""))
def latest_fix_as_of(spark, sf):
    r = adapter.readings(spark, sf).select("user_id", "t_us", "event_id", "event_type", "latitude", "longitude")
    left, right = r.where("event_type = 'click'").drop("event_type"), r.where("event_type = 'view'").drop("event_type")
    out = asof.asof_last(left, right, ["user_id"], max_age_s=60.0, name="fix")
    return out.select("event_id", F.col("fix.event_id").alias("fix_event"), F.round("fix_age_s", 6).alias("age_s"))
