"""Read-side queries: filters, sorts, limits and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import geo
from tracewell.operators import serving
from tracewell.plans import adapter
from tracewell.plans.context_queries import SCORE, operational
from tracewell.plans.ingest_queries import STAT_COLUMNS, stats_sql
from tracewell.plans.registry import query, rounded
from tracewell.plans.sqltext import READINGS, hav, pts, q
from tracewell.plans.window_queries import hex_sql

ALERTS = SCORE + """,
al AS (SELECT event_id, user_id, t_us, risk_tier, CASE WHEN k % 3 = 0 THEN 'PENDING' WHEN k % 3 = 1 THEN 'AUTO_RESOLVED' ELSE 'DISMISSED_SAFE' END AS status,
  CASE WHEN k % 2 = 0 THEN 'behavioral_escalation' END AS zone_id FROM os WHERE risk_tier IN ('SUSPICIOUS', 'CRITICAL'))"""


def alerts(spark, sf):
    return operational(spark, sf).where("risk_tier IN ('SUSPICIOUS', 'CRITICAL')").selectExpr(
        "event_id", "user_id", "t_us", "risk_tier",
        "CASE WHEN k % 3 = 0 THEN 'PENDING' WHEN k % 3 = 1 THEN 'AUTO_RESOLVED' ELSE 'DISMISSED_SAFE' END AS status",
        "CASE WHEN k % 2 = 0 THEN 'behavioral_escalation' END AS zone_id",
    )


@query("qry1_user_alerts", q(ALERTS, "SELECT * FROM al WHERE user_id = '7' AND status = 'PENDING' ORDER BY t_us DESC, event_id DESC LIMIT 50"))
def user_alerts(spark, sf):
    return serving.user_alerts(alerts(spark, sf), "7", status="PENDING")


@query("qry2_risk_history_range", q(SCORE, "SELECT event_id, t_us, risk_score FROM os WHERE user_id = '7' AND t_us BETWEEN 1704600000000000 AND 1706000000000000 ORDER BY t_us, event_id LIMIT 500"))
def history_range(spark, sf):
    return serving.risk_history(operational(spark, sf), "7", 1704600000000000, 1706000000000000).select("event_id", "t_us", "risk_score")


@query("qry2_newest_risk_history", q(SCORE, "SELECT event_id, t_us, risk_score FROM os WHERE user_id = '7' ORDER BY t_us DESC, event_id DESC LIMIT 20"))
def newest_history(spark, sf):
    return serving.risk_history(operational(spark, sf), "7", limit=20).select("event_id", "t_us", "risk_score")


@query("qry3_stored_json_parts", q(READINGS, """SELECT event_id, CASE WHEN k % 4 > 1 THEN round(latitude, 6) END AS lat,
  CASE WHEN k % 4 = 3 THEN 'ACTIVE' END AS engine_status FROM readings"""))
def stored_parts(spark, sf):
    text = F.expr(
        "CASE k % 4 WHEN 0 THEN '{broken' WHEN 1 THEN '{\"location\": {\"lat\": 1.0}}' "
        "WHEN 2 THEN to_json(named_struct('location', named_struct('lat', latitude, 'lng', longitude))) "
        "ELSE to_json(named_struct('location', named_struct('lat', latitude, 'lng', longitude), "
        "'ml_evaluation', named_struct('engine_status', 'ACTIVE'))) END"
    )
    r = adapter.readings(spark, sf).withColumn("raw_output_json", text)
    p = serving.stored_parts(r)
    return p.select("event_id", F.round("location.lat", 6).alias("lat"), F.col("ml_evaluation")["engine_status"].alias("engine_status"))


@query("qry4_wearable_history", q(READINGS, "SELECT event_id, t_us, heart_rate_bpm FROM wearables WHERE user_id = '7' ORDER BY t_us DESC, event_id DESC LIMIT 15"))
def wearable_history(spark, sf):
    w = serving.wearable_history(adapter.wearables(spark, sf), "7", 15)
    return w.select("event_id", "t_us", F.col("heart_rate_bpm").cast("bigint").alias("heart_rate_bpm"))


NOW = 1706659200000000
STEP = "CAST((v % 7) - 3 AS DOUBLE)*0.0002e0"
ACC = READINGS + f""",
se AS (SELECT event_id, CASE k % 4 WHEN 0 THEN 'PENDING_INVITE' WHEN 1 THEN 'ENDED' ELSE 'ACTIVE' END AS status, k % 90 > 60 AS stale,
    {hav('latitude', 'longitude', f'latitude+{STEP}', 'longitude')} AS d, k % 11 = 0 AS nofix, v % 2 = 0 AS po, v % 3 = 0 AS co,
    CASE v % 5 WHEN 0 THEN 'REUNITE_PENDING' WHEN 1 THEN 'SEPARATION_PENDING' END AS ms FROM readings WHERE event_type = 'signup'),
sf AS (SELECT *, status = 'ACTIVE' AND NOT nofix AND NOT stale AS ok FROM se WHERE status IN ('ACTIVE', 'PENDING_INVITE'))"""


@query("qry5_accompaniment", q(ACC, """SELECT event_id, CASE WHEN ok THEN round(d, 1) END AS separation_distance_m, CASE WHEN NOT ok THEN 'ACCOMPANIMENT_UNVERIFIED'
  WHEN ms = 'REUNITE_PENDING' THEN 'REJOINING' WHEN ms IS NOT NULL THEN ms WHEN round(d, 1) <= 50 THEN 'WITH_COMPANION' ELSE 'SEPARATED' END AS accompaniment_status,
  ok AND round(d, 1) <= 50 AND po AND co AS safe_zone_departure_accompanied FROM sf"""))
def accompaniment(spark, sf):
    s = adapter.readings(spark, sf).where("event_type = 'signup'").selectExpr(
        "event_id", "CASE k % 4 WHEN 0 THEN 'PENDING_INVITE' WHEN 1 THEN 'ENDED' ELSE 'ACTIVE' END AS status",
        "latitude AS patient_lat", "longitude AS patient_lng",
        "CASE WHEN k % 11 <> 0 THEN latitude + ((v % 7) - 3)*0.0002D END AS companion_lat", "CASE WHEN k % 11 <> 0 THEN longitude END AS companion_lng",
        f"{NOW}L - (k % 90)*1000000 AS companion_us", "v % 2 = 0 AS patient_outside", "v % 3 = 0 AS companion_outside",
        "CASE v % 5 WHEN 0 THEN 'REUNITE_PENDING' WHEN 1 THEN 'SEPARATION_PENDING' END AS machine_status",
    )
    a = serving.accompaniment(s, NOW)
    return a.select("event_id", "separation_distance_m", "accompaniment_status", "safe_zone_departure_accompanied")


@query("qry6_zone_list", q(READINGS, "SELECT zone_id, name, geometry_type FROM zones WHERE user_id = '8' AND is_enabled"))
def zone_list(spark, sf):
    return serving.zone_list(adapter.zones(spark, sf), "8").select("zone_id", "name", "geometry_type")


@query("qry7_alert_counts", q(ALERTS, "SELECT status, count(*) AS n FROM al GROUP BY 1"))
def alert_counts(spark, sf):
    return serving.status_counts(alerts(spark, sf))


@query("qry8_trips_per_user", q(pts(), "SELECT user_id, count(DISTINCT trajectory_id) AS trips, count(*) AS points FROM pts GROUP BY 1"))
def trips_per_user(spark, sf):
    return serving.exploration(adapter.points(spark, sf))[0]


@query("qry8_trip_distributions", q(pts(), f"""SELECT metric, {stats_sql('v')} FROM (
  SELECT 'points' AS metric, count(*)::DOUBLE AS v FROM pts GROUP BY trajectory_id
  UNION ALL SELECT 'duration_s', (max(t_us)-min(t_us))/1e6 FROM pts GROUP BY trajectory_id) GROUP BY 1"""))
def trip_distributions(spark, sf):
    return rounded(serving.exploration(adapter.points(spark, sf))[1], 6, STAT_COLUMNS)


RETAIN = SCORE + ", rx AS (" + hex_sql("*", "(SELECT os.*, latitude, longitude FROM os JOIN readings USING (event_id))") + ")"
CUT = NOW - 12 * 86_400_000_000


def scored_cells(spark, sf):
    return operational(spark, sf).withColumn("cell", geo.hex_cell("latitude", "longitude"))


@query("qry10_cell_rollup", q(RETAIN, """SELECT cell, t_us // 86400000000 AS day, count(*) AS readings, round(avg(risk_score), 4) AS mean_score, max(risk_score) AS max_score,
  count(DISTINCT user_id) AS users FROM rx GROUP BY 1, 2"""))
def cell_rollup(spark, sf):
    return rounded(serving.retention(scored_cells(spark, sf), NOW)[1], 4, ["mean_score"])


@query("qry10_retained_rows", q(RETAIN, f"SELECT event_id, cell FROM rx WHERE t_us >= {CUT}"))
def retained_rows(spark, sf):
    return serving.retention(scored_cells(spark, sf), NOW, 12)[0].select("event_id", "cell")
