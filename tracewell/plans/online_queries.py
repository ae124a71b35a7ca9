"""The online chain over several micro-batches with late rows; the oracles walk the machines one after the other."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import geo
from tracewell.operators import states
from tracewell.plans import adapter
from tracewell.plans.context_queries import ZONED
from tracewell.plans.profile_queries import rq
from tracewell.plans.registry import query
from tracewell.plans.sqltext import hav
from tracewell.plans.state_queries import NUM, ST1, ST2, ST3, ST4, ST5, ST6_STEP, walk
from tracewell.plans.window_queries import hex_sql
from tracewell.session import scratch_dir, side_by_side, store
from tracewell.sources import sinks
from tracewell.streaming import online

INPUTS = (
    "k % 17 <> 0 AS engine_ok", "k % 19 = 0 AS engine_inside", "k % 5 <> 0 AS window_evaluated", "concat(trajectory_id, '_', t_us div 60000000) AS window_id",
    "CASE v % 6 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'RANDOM_DRIFT' ELSE 'PACING' END AS pattern", "0.7D + (k % 30) / 100.0D AS confidence",
    "v % 4 = 0 AS is_corroborating_risk", "v % 3 = 0 AS is_looping", "CASE WHEN v % 7 = 1 THEN 'PROGRESSIVE_TRANSIT' ELSE 'ORDINARY_TURN' END AS loop_pattern",
    "k % 6 = 0 AS is_aroused", "k % 23 = 0 AS loop_closed", "k % 29 = 0 AS group_closed", "CASE WHEN k % 4 <> 0 THEN CAST(v % 101 AS DOUBLE) END AS model_score",
    "CAST(CASE WHEN event_type = 'click' THEN 60 + v % 90 END AS INT) AS heart_rate_bpm", "CASE WHEN k % 5 = 0 THEN 'OFF_WRIST' ELSE 'ON_WRIST' END AS wear_state",
)
RUNS: dict[tuple[str, str], str] = {}


def multipliers(spark, sf) -> DataFrame:
    """Multiplier of every cell after the last of its dismissals (the error events)."""
    p = adapter.points(spark, sf).where("event_type = 'error'")
    d = p.select("event_id", geo.hex_cell("latitude", "longitude").alias("cell"), geo.micros("timestamp").alias("t_us"))
    return states.dismissal_quota(d).groupBy("cell").agg(F.max_by("multiplier", F.struct("t_us", "event_id")).alias("cell_multiplier"))


def ingested(spark, sf) -> str:
    """Folder of the ingest of all events in micro-batches; run once per application and input."""
    at = spark.sparkContext.applicationId, sf
    if at not in RUNS:
        out = scratch_dir(spark)
        rows = adapter.readings(spark, sf).selectExpr("* EXCEPT (timestamp, uid)", *INPUTS)
        # Stored, as every micro-batch reads them.
        stream, factors = side_by_side(spark, lambda: adapter.arrivals(spark, rows), lambda: store(multipliers(spark, sf)))
        fix = F.coalesce(F.col("event_type") == "view", F.lit(False))
        fixes = stream.where(fix).withColumn("accuracy_m", F.expr("3.0D + v % 24"))
        online.ingest(stream.where(~fix), adapter.zones(spark, sf), adapter.consent(spark, sf), out, f"{out}/checkpoint", fixes, factors).awaitTermination()
        RUNS[at] = out
    return RUNS[at]


def events(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{ingested(spark, sf)}/events")


def tagged(sql: str, tag: str) -> str:
    """The walk of another oracle under names of its own, over the readings ``rd``."""
    steps = ",\nseq AS" + sql.split(",\nseq AS", 1)[1]
    return re.sub(r"\b(seq|rec)\b", rf"\g<1>{tag}", re.sub(r"\b(FROM|JOIN) readings\b", r"\1 rd", steps))


CONSENTED = """user_id IN (SELECT user_id FROM consent WHERE guardian_granted AND (NOT end_user_consent_applicable OR coalesce(end_user_granted, false)))"""
RD = ZONED + f""",
rd AS (SELECT * FROM readings WHERE event_type <> 'view' AND {CONSENTED})"""
FENCE = tagged(ST2, "2")
SEQ3C = """SELECT r.user_id, r.event_id, v % 3 = 0 AS is_looping, CASE WHEN v % 7 = 1 THEN 'PROGRESSIVE_TRANSIT' ELSE 'ORDINARY_TURN' END AS pattern,
  v % 4 = 0 AS is_corroborating_risk, coalesce(z.ins, false) AS inside_zone, k % 23 = 0 AS closed, row_number() OVER (PARTITION BY r.user_id ORDER BY t_us, r.event_id) AS n
  FROM rd r LEFT JOIN (SELECT event_id, bool_or(st = 'INSIDE') AS ins FROM gf GROUP BY 1) z ON z.event_id = r.event_id"""
SEQ4C = f"""SELECT r.user_id, r.event_id, {hav('r.latitude', 'r.longitude', 'c.latitude', 'c.longitude')} > 50 AS apart, r.k % 6 = 0 AS aroused, r.k % 29 = 0 AS closed,
  CASE WHEN r.is_degraded OR r.accuracy_m > 25 THEN 'INSUFFICIENT_GPS' WHEN c.event_id IS NULL THEN 'ACCOMPANIMENT_UNVERIFIED' WHEN 3.0 + c.v % 24 > 25 THEN 'INSUFFICIENT_GPS' END AS problem,
  row_number() OVER (PARTITION BY r.user_id ORDER BY r.t_us, r.event_id) AS n FROM rd r LEFT JOIN fx ON fx.event_id = r.event_id LEFT JOIN readings c ON c.event_id = fx.fix_event"""
FX = """,
fx AS (SELECT p.event_id, arg_max(f.event_id, (f.t_us, f.event_id)) AS fix_event FROM rd p JOIN readings f ON f.user_id = p.user_id AND f.event_type = 'view'
  AND f.t_us <= p.t_us AND f.t_us >= p.t_us - 60000000 GROUP BY 1)"""


def _with_input(sql: str, seq: str, tag: str) -> str:
    """A tagged walk whose input rows are replaced by ``seq``."""
    rest = tagged(sql, tag).split(f"),\nrec{tag} AS", 1)[1]
    return f",\nseq{tag} AS ({seq}),\nrec{tag} AS" + rest


LOOP = _with_input(ST3, SEQ3C, "3")
GROUP = FX + _with_input(ST4, SEQ4C, "4")
ESCALATION = tagged(ST5, "5")
CELLED = ", rc AS (" + hex_sql("*", "rd") + "), dx AS (" + hex_sql("*", "(SELECT * FROM readings WHERE event_type = 'error')") + ")"
DISMISSED = walk(
    f"SELECT event_id, cell, t_us, {NUM.format(key='cell')} FROM dx", "cell", "CAST(NULL AS BIGINT) AS clock, 0 AS cnt, false AS allowed", "", ST6_STEP
)
HISTORY = RD + tagged(ST1, "1") + ESCALATION + CELLED + re.sub(r"\b(seq|rec)\b", r"\g<1>6", DISMISSED) + """,
mu AS (SELECT cell, arg_max(1.0e0-least(0.3e0, 0.1e0*cnt), n) AS mult FROM rec6 WHERE n > 0 GROUP BY 1),
oc0 AS (SELECT rc.*, rec5.lvl, rec1.s AS tier, CASE WHEN is_degraded THEN CASE rec1.s WHEN 2 THEN 75.0 WHEN 1 THEN 50.0 ELSE 15.0 END
    ELSE least(100.0, coalesce(CASE WHEN k % 4 <> 0 THEN (v % 101)::DOUBLE END, least(60.0, speed_mps*12.0))) END * coalesce(mult, 1.0e0) AS raw
  FROM rc JOIN rec5 ON rec5.event_id = rc.event_id LEFT JOIN rec1 ON rec1.event_id = rc.event_id LEFT JOIN mu ON mu.cell = rc.cell),
oc1 AS (SELECT *, round(greatest(0.0, least(100.0, raw)), 1) AS sc FROM oc0),
oc2 AS (SELECT *, CASE WHEN sc <= 34 THEN 0 WHEN sc <= 64 THEN 1 WHEN sc <= 84 THEN 2 ELSE 3 END AS tn FROM oc1),
oc3 AS (SELECT *, CASE WHEN lvl = 85 THEN 3 WHEN lvl > 0 AND tn < 2 THEN 2 ELSE tn END AS mt, CASE WHEN lvl = 85 OR (lvl > 0 AND tn < 2) THEN greatest(sc, lvl) ELSE sc END AS ms FROM oc2),
hs AS (SELECT *, ms AS risk_score, ['QUIESCENT', 'NORMAL_TRANSIT', 'SUSPICIOUS', 'CRITICAL'][mt + 1] AS risk_tier, greatest(tn, mt) AS polling_tier,
    CASE WHEN tn >= 2 THEN round(greatest(240.0, 900.0-(sc-65.0)*15.0), 1) WHEN lvl > 0 THEN round(greatest(240.0, 900.0-(ms-65.0)*15.0), 1) END AS lead_s,
    CASE WHEN mt = 3 AND k < 5 THEN 'LAST_GASP' WHEN mt = 2 AND k < 15 THEN 'PULSE' ELSE 'CONTINUOUS' END AS mode FROM oc3)"""


@query("stm9_ingest_history", rq(HISTORY, "SELECT user_id, event_id, t_us, cell, risk_score, risk_tier, CAST(polling_tier AS BIGINT) AS polling_tier, lead_s, mode FROM hs"))
def ingest_history(spark, sf):
    h = spark.read.parquet(f"{ingested(spark, sf)}/history")
    return h.select(
        "user_id", "event_id", "t_us", "cell", "risk_score", "risk_tier", F.col("polling_tier").cast("bigint").alias("polling_tier"),
        F.col("predicted_lead_time_sec").alias("lead_s"), "polling.mode",
    )


@query("stm9_ingest_alerts", rq(HISTORY, """SELECT user_id, cell, min(t_us) AS opened_us, max(t_us) AS updated_us, CAST(arg_max(mt, (t_us, event_id)) AS BIGINT) AS alert_tier, count(*) AS readings,
  CASE WHEN arg_min(lvl, (t_us, event_id)) > 0 THEN 'behavioral_escalation' END AS zone_id, 'PENDING' AS status FROM hs WHERE mt >= 2 GROUP BY 1, 2"""))
def ingest_alerts(spark, sf):
    a = sinks.read_merged(spark, f"{ingested(spark, sf)}/alerts")
    return a.select("user_id", "cell", "opened_us", "updated_us", "alert_tier", "readings", "zone_id", "status")


@query("stm9_ingest_wearables", rq(RD, """SELECT event_id, user_id, t_us, 60 + v % 90 AS heart_rate_bpm, CASE WHEN k % 5 = 0 THEN 'OFF_WRIST' ELSE 'ON_WRIST' END AS wear_state
  FROM rd WHERE event_type = 'click'"""))
def ingest_wearables(spark, sf):
    w = spark.read.parquet(f"{ingested(spark, sf)}/wearables")
    return w.select("event_id", "user_id", "t_us", F.col("heart_rate_bpm").cast("bigint").alias("heart_rate_bpm"), "wear_state")


@query("stm9_ingest_geofence", rq(RD + FENCE, "SELECT event_id, zone_id, st AS state, action, status FROM gf"))
def ingest_geofence(spark, sf):
    e = events(spark, sf).where("event_id IS NOT NULL")
    z = e.select("event_id", F.explode(F.arrays_zip("zone_ids", "zone_states", "zone_actions", "zone_status")).alias("z"))
    return z.select("event_id", F.col("z.zone_ids").alias("zone_id"), F.col("z.zone_states").alias("state"), F.col("z.zone_actions").alias("action"), F.col("z.zone_status").alias("status"))


@query("stm9_ingest_loop_alerts", rq(RD + FENCE + LOOP, "SELECT event_id, act AS action, CASE WHEN op THEN tier END AS alert_tier FROM rec3 WHERE n > 0"))
def ingest_loop_alerts(spark, sf):
    """Loop alerts released by the geofence state of the same reading."""
    return events(spark, sf).where("event_id IS NOT NULL").select("event_id", F.col("loop_action").alias("action"), F.col("loop_tier").alias("alert_tier"))


@query("stm9_ingest_group", rq(RD + GROUP, "SELECT event_id, coalesce(problem, st) AS status, act AS action, CASE WHEN tier > 0 AND pend THEN tier END AS alert_tier FROM rec4 WHERE n > 0"))
def ingest_group(spark, sf):
    """Separation of patient and companion, who meet in the stream under the patient's key."""
    e = events(spark, sf).where("event_id IS NOT NULL")
    return e.select("event_id", F.col("group_status").alias("status"), F.col("group_action").alias("action"), F.col("group_tier").alias("alert_tier"))


@query("stm9_ingest_escalation", rq(RD + ESCALATION, "SELECT event_id, lvl > 0 AS is_escalated, CASE WHEN lvl = 85 THEN 'CRITICAL' WHEN lvl > 0 THEN 'SUSPICIOUS' END AS target_tier FROM rec5 WHERE n > 0"))
def ingest_escalation(spark, sf):
    return events(spark, sf).where("event_id IS NOT NULL").select("event_id", "is_escalated", "target_tier")


@query("stm9_ingest_stale_companions", rq(RD, f"""SELECT user_id, t_us + 60000000 AS stale_us FROM (
  SELECT user_id, t_us, lead(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS next_us FROM readings WHERE event_type = 'view' AND {CONSENTED})
  WHERE next_us IS NULL OR next_us > t_us + 60000000"""))
def ingest_stale_companions(spark, sf):
    """When a companion's position went stale, told by a timer even if no reading came."""
    return events(spark, sf).where("event_id IS NULL").select("user_id", F.col("t_us").alias("stale_us"))
