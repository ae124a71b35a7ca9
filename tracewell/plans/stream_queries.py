"""Streaming jobs over the events table, run until the source is exhausted and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans import adapter
from tracewell.plans.profile_queries import rq
from tracewell.plans.registry import query, rounded
from tracewell.plans.sqltext import READINGS, q, win
from tracewell.plans.state_queries import ST1, ST2
from tracewell.session import scratch_dir
from tracewell.sources import sinks, telemetry
from tracewell.streaming import jobs


def finish(stream: DataFrame) -> DataFrame:
    """Run a stream over what its source holds and return its output."""
    out = scratch_dir(stream.sparkSession)
    started = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def live(spark, sf) -> DataFrame:
    r = adapter.readings(spark, sf, adapter.event_stream(spark, sf))
    return r.withColumn("event_time", F.timestamp_micros("t_us"))


STREAM_WIN = win(1000).replace("uid || '_' || (us // 259200000000) AS trajectory_id", "uid || '_stream' AS trajectory_id")


def staged(spark, sf, *more: str) -> DataFrame:
    """All readings in several micro-batches, many of them late."""
    r = adapter.readings(spark, sf).select("user_id", "event_id", "t_us", "latitude", "longitude", *more)
    return adapter.arrivals(spark, r)


@query("stm1_stream_windows", q(STREAM_WIN, "SELECT window_id, point_count, first_us, last_us, is_full AS is_full_window FROM win"))
def stream_windows(spark, sf):
    return finish(jobs.window_stream(staged(spark, sf))).select("window_id", "point_count", "first_us", "last_us", "is_full_window")


@query("stm4_lag_window_guard", q(STREAM_WIN, """SELECT window_id, coalesce(lag(window_index) OVER (PARTITION BY trajectory_id, segment_index ORDER BY window_index) = window_index-1, false) AS follows_previous FROM win"""))
def lag_guard(spark, sf):
    return finish(jobs.window_stream(staged(spark, sf))).select("window_id", "follows_previous")


@query("stm2_trailing_history", q(READINGS, """SELECT event_id, least(count(*) OVER w, 500) AS history_points, round((t_us - min(t_us) OVER w)/1e6, 6) AS history_s FROM readings
  WINDOW w AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 1200000000 PRECEDING AND CURRENT ROW)"""))
def trailing_history(spark, sf):
    h = finish(jobs.history_stream(staged(spark, sf)))
    return rounded(h.select("event_id", F.col("history_points").cast("bigint").alias("history_points"), "history_s"), 6, ["history_s"])


@query("stm3_stream_deduplication", q(READINGS, "SELECT user_id, count(DISTINCT t_us) AS readings FROM readings GROUP BY 1"))
def stream_deduplication(spark, sf):
    twice = live(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return finish(jobs.deduplicated(twice)).groupBy("user_id").agg(F.count("*").alias("readings"))


FREEZE = READINGS + """,
fz AS (SELECT *, (v % 97)/1.0e0 AS score FROM readings),
fh AS (SELECT *, last_value(CASE WHEN NOT is_degraded THEN score END IGNORE NULLS) OVER w AS held, last_value(CASE WHEN NOT is_degraded THEN t_us END IGNORE NULLS) OVER w AS held_us
  FROM fz WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("stm5_score_freeze", q(FREEZE, """SELECT event_id, CASE WHEN NOT is_degraded THEN score WHEN net_displacement_m > 50 THEN greatest(coalesce(held, 20.0), 75.0)
  WHEN net_displacement_m > 25 THEN greatest(coalesce(held, 20.0), 40.0) ELSE coalesce(held, 20.0) END AS risk_score,
  is_degraded AND coalesce((t_us-held_us)/1e6 > 900, false) AS past_blind_spot FROM fh"""))
def score_freeze(spark, sf):
    r = adapter.readings(spark, sf).withColumn("score", F.expr("(v % 97)/1.0D"))
    return jobs.frozen_scores(r).select("event_id", "risk_score", "past_blind_spot")


@query("stm5_stream_score_freeze", q(FREEZE, """SELECT event_id, CASE WHEN NOT is_degraded THEN score WHEN net_displacement_m > 50 THEN greatest(coalesce(held, 20.0), 75.0)
  WHEN net_displacement_m > 25 THEN greatest(coalesce(held, 20.0), 40.0) ELSE coalesce(held, 20.0) END AS risk_score FROM fh"""))
def stream_score_freeze(spark, sf):
    return monitored(spark, sf).select("event_id", F.col("frozen_score").alias("risk_score")).distinct()


@query("stm6_evidence_status", q(STREAM_WIN, """SELECT p.event_id, arg_max(c.window_id, c.last_us) AS window_id, CASE WHEN max(c.last_us) IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'WINDOW_EVALUATED' END AS evidence_status
  FROM pts p LEFT JOIN win c ON c.user_id = p.user_id AND c.last_us < p.t_us GROUP BY 1"""))
def evidence_status(spark, sf):
    return finish(jobs.evidence_stream(staged(spark, sf))).select("event_id", "window_id", "evidence_status")


@query("stm7_consented_stream", q(READINGS, """SELECT event_id FROM readings WHERE user_id IN (SELECT user_id FROM consent
  WHERE guardian_granted AND (NOT end_user_consent_applicable OR coalesce(end_user_granted, false)))"""))
def consented_stream(spark, sf):
    return finish(jobs.consented_stream(live(spark, sf), adapter.consent(spark, sf)).select("event_id"))


@query("stm8_stream_latest_fix", q(READINGS, """SELECT l.event_id, arg_max(r.event_id, (r.t_us, r.event_id)) AS fix_event FROM readings l JOIN readings r ON r.user_id = l.user_id
  AND r.event_type = 'view' AND l.event_type = 'click' AND r.t_us <= l.t_us AND r.t_us >= l.t_us - 60000000 GROUP BY 1"""))
def stream_latest_fix(spark, sf):
    r = staged(spark, sf, "event_type")
    patients = r.where("event_type = 'click' OR event_type IS NULL")
    out = finish(jobs.latest_fix_stream(patients, r.where("event_type = 'view'")))
    return out.where("fix_event IS NOT NULL").select("event_id", "fix_event")


def monitored(spark, sf) -> DataFrame:
    stream = live(spark, sf).withColumn("score", F.expr("(v % 97)/1.0D"))
    return finish(jobs.monitor_stream(stream, adapter.zones(spark, sf)))


@query("stm9_stream_geofence", rq(ST2, "SELECT event_id, zone_id, st AS state, action, status FROM gf"))
def stream_geofence(spark, sf):
    return monitored(spark, sf).where("zone_id IS NOT NULL").select("event_id", "zone_id", "state", "action", "status")


@query("stm9_stream_displacement", rq(ST1, """SELECT event_id, CASE s WHEN 0 THEN 'INDOOR_PACING' WHEN 1 THEN 'ZONE_TRANSITION'
  ELSE 'UNTRACKED_DISPLACEMENT' END AS pdr_tier FROM rec WHERE n > 0"""))
def stream_displacement(spark, sf):
    return monitored(spark, sf).where("pdr_tier IS NOT NULL").select("event_id", "pdr_tier").distinct()


# --- events as documents and keyed sinks ----------------------------------------------------

BAD = """CASE WHEN k = 3 THEN 'location' WHEN k = 4 THEN 'speed' WHEN k = 5 THEN 'battery' WHEN k = 6 THEN 'signal_state'
  WHEN is_degraded AND k % 3 = 0 THEN 'imu_required' WHEN k % 5 = 0 AND v % 90 > 80 THEN 'heart_rate' END"""


def documents(r: DataFrame) -> DataFrame:
    """Readings as JSON text; some break a rule of the event contract."""
    part = lambda *c: F.struct(*c)
    event = part(
        "user_id", F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        part(F.expr("CASE WHEN k = 3 THEN 99.0D ELSE latitude END").alias("lat"), F.col("longitude").alias("lng")).alias("location"),
        part(
            F.col("accuracy_m").alias("horizontal_accuracy_m"), F.expr("CASE WHEN k = 4 THEN -1.0D ELSE speed_mps END").alias("speed_mps"),
            F.lit(90.0).alias("heading_deg"), F.expr("CASE WHEN k = 5 THEN 101 ELSE battery_pct END").alias("battery_pct"),
        ).alias("sensor_metrics"),
        F.when(F.expr("NOT (is_degraded AND k % 3 = 0)"), part(
            F.lit(1).alias("step_count_since_last_gps"), "net_displacement_m", F.lit("INDOOR_PACING").alias("pdr_tier_state"))).alias("imu_metrics"),
        part(F.expr("CASE WHEN k = 6 THEN 'LOST' WHEN is_degraded THEN 'DEGRADED_SIGNAL' ELSE 'VALID' END").alias("state")).alias("signal_status"),
        F.when(F.expr("k % 5 = 0"), part(
            F.expr("CAST(CASE WHEN v % 90 > 80 THEN 251 ELSE 60 END AS INT)").alias("heart_rate_bpm"), F.lit("ON_WRIST").alias("wear_state"))).alias("wearable_metrics"),
    )
    return r.select("event_id", F.to_json(event).alias("value"))


@query("src5_telemetry_validation", q(READINGS, f"SELECT event_id, {BAD} AS rejected FROM readings"))
def telemetry_validation(spark, sf):
    return telemetry.parse(documents(adapter.readings(spark, sf))).select("event_id", "rejected")


@query("src5_telemetry_stream", q(READINGS, f"SELECT rejected, count(*) AS n FROM (SELECT {BAD} AS rejected FROM readings) GROUP BY 1"))
def telemetry_stream(spark, sf):
    parsed = telemetry.parse(documents(live(spark, sf))).select("event_id", "rejected")
    return finish(parsed).groupBy("rejected").agg(F.count("*").alias("n"))


def _by_batch(stream: DataFrame, write) -> None:
    out = scratch_dir(stream.sparkSession)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()


@query("snk2_risk_history", q(READINGS, "SELECT event_id, user_id, t_us, round(speed_mps*12, 6) AS risk_score FROM readings"))
def risk_history_sink(spark, sf):
    out = scratch_dir(spark)
    rows = live(spark, sf).select("event_id", "user_id", "t_us", F.round(F.col("speed_mps") * 12, 6).alias("risk_score"))
    _by_batch(rows, lambda b, i: sinks.append_batch(b, i, out))
    return spark.read.parquet(out).drop("batch_id")


@query("snk3_latest_wins_merge", q(READINGS, "SELECT user_id, max(t_us) AS t_us, arg_max(event_id, (t_us, event_id)) AS event_id, arg_max(battery_pct, (t_us, event_id)) AS battery_pct FROM readings GROUP BY 1"))
def latest_wins(spark, sf):
    out = scratch_dir(spark)
    rows = staged(spark, sf, "battery_pct").where(F.col("user_id") != jobs.CLOSING_USER).select("user_id", "t_us", "event_id", F.col("battery_pct").cast("bigint").alias("battery_pct"))
    _by_batch(rows, lambda b, i: sinks.merge_batch(b, i, out, ["user_id"], ["t_us", "event_id"]))
    return sinks.read_merged(spark, out)


@query("snk4_wearable_readings", q(READINGS, "SELECT event_id, user_id, t_us, heart_rate_bpm, wear_state FROM wearables"))
def wearable_sink(spark, sf):
    out = scratch_dir(spark)
    rows = live(spark, sf).where("event_type IN ('click', 'view')").select(
        "event_id", "user_id", "t_us", F.expr("60 + v % 90").alias("heart_rate_bpm"),
        F.expr("CASE WHEN k % 5 = 0 THEN 'OFF_WRIST' ELSE 'ON_WRIST' END").alias("wear_state"),
    )
    _by_batch(rows, lambda b, i: sinks.append_batch(b, i, out))
    return spark.read.parquet(out).drop("batch_id")
