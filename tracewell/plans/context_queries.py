"""Queries over zones, familiar places, loops, heart rate and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import decision, heart, loops, zones
from tracewell.plans import adapter
from tracewell.plans.registry import query, rounded
from tracewell.plans.risk_queries import OWN, judged
from tracewell.plans.sqltext import READINGS, bearing, feat, hav, q, unit
from tracewell.plans.window_queries import feature_table
from tracewell.session import store

CIRC = hav("latitude", "longitude", "center_lat", "center_lng")
ZONED = READINGS + f""",
uz AS (SELECT * FROM zones WHERE is_enabled AND (geometry_type <> 'CIRCLE' OR radius_m > 0)),
ring AS (SELECT user_id, zone_id, unnest([0,1,2,3]) AS i,
    39.9e0 + CAST(CAST(user_id AS BIGINT) % 40 AS DOUBLE)*0.01e0 + 0.00001e0 AS la,
    116.3e0 + CAST(CAST(user_id AS BIGINT) % 25 AS DOUBLE)*0.01e0 + 0.00001e0 AS lo
  FROM uz WHERE geometry_type = 'POLYGON'),
edges AS (SELECT user_id, zone_id,
    la + CASE WHEN i IN (2, 3) THEN 0.0006e0 ELSE 0.0 END AS a_la, lo + CASE WHEN i IN (1, 2) THEN 0.0006e0 ELSE 0.0 END AS a_lo,
    la + CASE WHEN i IN (1, 2) THEN 0.0006e0 ELSE 0.0 END AS b_la, lo + CASE WHEN i IN (0, 1) THEN 0.0006e0 ELSE 0.0 END AS b_lo
  FROM ring),
pm AS (SELECT r.event_id, e.zone_id, r.latitude, r.longitude, a_la, a_lo, b_la, b_lo,
    (a_lo-longitude)*111412.84e0*cos(radians(latitude)) AS x1, (a_la-latitude)*(111132.92e0-559.82e0*cos(2*radians(latitude))) AS y1,
    (b_lo-a_lo)*111412.84e0*cos(radians(latitude)) AS dx, (b_la-a_la)*(111132.92e0-559.82e0*cos(2*radians(latitude))) AS dy
  FROM readings r JOIN edges e USING (user_id)),
pe AS (SELECT *, CASE WHEN dx*dx+dy*dy = 0 THEN 0.0 ELSE {unit('-(x1*dx+y1*dy)/(dx*dx+dy*dy)')} END AS tt,
    CASE WHEN least(a_la, b_la) < latitude AND latitude <= greatest(a_la, b_la)
      AND longitude <= (latitude-a_la)*(b_lo-a_lo)/(b_la-a_la)+a_lo THEN 1 ELSE 0 END AS hit FROM pm),
pd AS (SELECT event_id, zone_id, min(sqrt(pow(x1+tt*dx, 2)+pow(y1+tt*dy, 2))) AS edge, sum(hit) % 2 = 1 AS inside FROM pe GROUP BY 1, 2),
zd AS (
  SELECT r.event_id, z.zone_id, z.name, {CIRC}-radius_m AS d, {CIRC} <= radius_m AS inside FROM readings r JOIN uz z USING (user_id) WHERE geometry_type = 'CIRCLE'
  UNION ALL SELECT event_id, zone_id, 'garden', CASE WHEN inside THEN -edge ELSE edge END, inside FROM pd)"""


@query("zon1_circle_distance", q(ZONED, "SELECT event_id, zone_id, round(d, 4) AS distance_m, inside FROM zd WHERE name = 'home'"))
def circle_distance(spark, sf):
    return _zone_rows(spark, sf, "home")


def _zone_rows(spark, sf, name):
    d = zones.with_zone_distances(adapter.readings(spark, sf), adapter.zones(spark, sf))
    each = d.select("event_id", F.explode("zone_distances").alias("z")).where(F.col("z.name") == name)
    return each.select(
        "event_id", "z.zone_id", F.round("z.distance", 4).alias("distance_m"), "z.inside"
    )


@query("zon2_polygon_contains", q(ZONED, "SELECT event_id, zone_id, inside FROM pd"))
def polygon_contains(spark, sf):
    return _zone_rows(spark, sf, "garden").select("event_id", "zone_id", "inside")


@query("zon3_polygon_edge_distance", q(ZONED, "SELECT event_id, zone_id, round(edge, 4) AS edge_m FROM pd"))
def edge_distance(spark, sf):
    rows = _zone_rows(spark, sf, "garden")
    return rows.select("event_id", "zone_id", F.abs("distance_m").alias("edge_m"))


SAFE = ZONED + """,
best AS (SELECT event_id, arg_min(d, (NOT inside, d)) AS d, arg_min(name, (NOT inside, d)) AS name, bool_or(inside) AS held FROM zd GROUP BY 1),
safe AS (SELECT r.*, CASE WHEN d IS NULL THEN 'SAFE_AREA_UNAVAILABLE' WHEN held THEN 'INSIDE_SAFE_AREA'
    ELSE 'OUTSIDE_SAFE_AREA' END AS safe_area_state, round(d, 1) AS distance_to_safe_boundary_m,
    b.name AS matched_safe_area_name FROM readings r LEFT JOIN best b USING (event_id))"""
SAFE_COLUMNS = ["event_id", "safe_area_state", "distance_to_safe_boundary_m", "matched_safe_area_name"]


@query("zon4_safe_area_state", q(SAFE, f"SELECT {', '.join(SAFE_COLUMNS)} FROM safe"))
def safe_area(spark, sf):
    return zones.safe_area(adapter.readings(spark, sf), adapter.zones(spark, sf)).select(*SAFE_COLUMNS)


FAMILIAR = SAFE + f""",
an AS (SELECT user_id, user_id || '_' || event_type AS anchor_id, avg(latitude) AS la, avg(longitude) AS lo,
    20.0e0 + count(*) % 40 AS radius_m, CASE WHEN count(*) % 3 = 0 THEN 'CAREGIVER_CONFIRMED' WHEN count(*) % 3 = 1 THEN 'CONFIRMED'
    ELSE 'PENDING_CAREGIVER_REVIEW' END AS status FROM pts WHERE CAST(user_id AS BIGINT) % 13 <> 0 GROUP BY 1, 2, event_type),
tc AS (SELECT user_id, count(DISTINCT trajectory_id) - CAST(user_id AS BIGINT) % 8 AS trips FROM pts
  WHERE CAST(user_id AS BIGINT) % 11 <> 0 GROUP BY 1),
ad AS (SELECT s.event_id, anchor_id, status, {hav('s.latitude', 's.longitude', 'a.la', 'a.lo')} AS d, greatest(radius_m, 25.0) AS reach
  FROM safe s JOIN an a USING (user_id)),
am AS (SELECT event_id, min(d) AS d, arg_min(anchor_id, (d, anchor_id)) AS anchor_id, arg_min(status, (d, anchor_id)) AS status,
  bool_or(d <= reach) AS hit FROM ad GROUP BY 1),
fam AS (SELECT *, CASE WHEN familiarity_state IN ('FAMILIAR_LOCATION', 'UNFAMILIAR_LOCATION') THEN true ELSE false END AS ok FROM (
  SELECT s.*, coalesce(t.trips, 0) AS trip_count, m.anchor_id, m.status, m.d AS anchor_d,
    CASE WHEN coalesce(t.trips, 0) = 0 THEN 'NO_HISTORY' WHEN t.trips < 7 OR m.event_id IS NULL THEN 'INSUFFICIENT_EVIDENCE'
      WHEN m.hit THEN 'FAMILIAR_LOCATION' ELSE 'UNFAMILIAR_LOCATION' END AS familiarity_state
  FROM safe s LEFT JOIN tc t USING (user_id) LEFT JOIN am m USING (event_id)))"""
FAM_SQL = """familiarity_state, trip_count, CASE WHEN ok THEN anchor_id END AS nearest_anchor_id,
  CASE WHEN ok THEN round(anchor_d, 1) END AS distance_to_nearest_anchor_m, CASE WHEN ok THEN status END AS nearest_anchor_status,
  ok AND coalesce(status = 'CAREGIVER_CONFIRMED', false) AS is_caregiver_confirmed"""
FAM_COLUMNS = [
    "familiarity_state", "trip_count", "nearest_anchor_id", "distance_to_nearest_anchor_m", "nearest_anchor_status",
    "is_caregiver_confirmed",
]


def place_profiles(spark, sf):
    """Stand-in profiles: one anchor per event type of a user."""
    p = adapter.points(spark, sf)
    n = F.col("n")
    anchors = (
        p.where("uid % 13 <> 0").groupBy("user_id", "event_type")
        .agg(F.avg("latitude").alias("la"), F.avg("longitude").alias("lo"), F.count("*").alias("n"))
        .groupBy("user_id")
        .agg(F.collect_list(F.struct(
            F.concat_ws("_", "user_id", "event_type").alias("anchor_id"), F.col("la").alias("center_latitude"),
            F.col("lo").alias("center_longitude"), (20.0 + n % 40).alias("radius_m"),
            F.when(n % 3 == 0, "CAREGIVER_CONFIRMED").when(n % 3 == 1, "CONFIRMED").otherwise("PENDING_CAREGIVER_REVIEW").alias("status"),
        )).alias("anchors"))
    )
    trips = p.where("uid % 11 <> 0").groupBy("user_id", "uid").agg(F.countDistinct("trajectory_id").alias("t"))
    return trips.select("user_id", (F.col("t") - F.col("uid") % 8).alias("trip_count")).join(anchors, "user_id", "left")


@query("zon5_familiarity", q(FAMILIAR, f"SELECT event_id, {FAM_SQL} FROM fam"))
def familiarity(spark, sf):
    return zones.familiarity(adapter.readings(spark, sf), place_profiles(spark, sf)).select("event_id", *FAM_COLUMNS)


@query("zon6_spatial_context", q(FAMILIAR, f"SELECT {', '.join(SAFE_COLUMNS)}, {FAM_SQL} FROM fam"))
def spatial_context(spark, sf):
    c = zones.spatial_context(adapter.readings(spark, sf), adapter.zones(spark, sf), place_profiles(spark, sf))
    return c.select(*SAFE_COLUMNS, *FAM_COLUMNS)


# --- loops ----------------------------------------------------------------------------------

STEP = hav("pla", "plo", "latitude", "longitude")
LOOPS = READINGS + f""",
org AS (SELECT user_id, event_id AS origin_id, t_us AS origin_us FROM readings),
tk0 AS (SELECT o.origin_id, r.event_id, r.t_us, r.latitude, r.longitude, r.accuracy_m,
    row_number() OVER (PARTITION BY o.origin_id ORDER BY r.t_us DESC, r.event_id DESC) AS rr
  FROM org o JOIN readings r ON r.user_id = o.user_id AND r.t_us BETWEEN o.origin_us-1200000000 AND o.origin_us),
tk AS (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY t_us, event_id) AS i FROM tk0 WHERE rr <= 500 AND accuracy_m <= 25),
t1 AS (SELECT *, lag(t_us) OVER w AS pt, lag(latitude) OVER w AS pla, lag(longitude) OVER w AS plo,
    cos(radians(latitude))*cos(radians(longitude)) AS ux, cos(radians(latitude))*sin(radians(longitude)) AS uy, sin(radians(latitude)) AS uz
  FROM tk WINDOW w AS (PARTITION BY origin_id ORDER BY i)),
t2 AS (SELECT *, CASE WHEN i > 1 THEN {STEP} END AS step FROM t1),
t3 AS (SELECT *, CASE WHEN step >= 0.5 THEN {bearing('pla', 'plo', 'latitude', 'longitude')} END AS b,
    avg(ux) OVER g AS cx, avg(uy) OVER g AS cy, avg(uz) OVER g AS cz FROM t2 WINDOW g AS (PARTITION BY origin_id)),
t4 AS (SELECT *, fmod(b-last_value(b IGNORE NULLS) OVER (PARTITION BY origin_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+540.0, 360.0)-180.0 AS turn,
    degrees(atan2(cz, sqrt(cx*cx+cy*cy))) AS clat, degrees(atan2(cy, cx)) AS clon FROM t3),
t5 AS (SELECT origin_id, count(*) AS points, (max(t_us)-min(t_us))/1e6 AS duration_sec, max((t_us-pt)/1e6) AS gap,
    coalesce(sum(step), 0.0) AS path, arg_min(latitude, i) AS ala, arg_min(longitude, i) AS alo, arg_max(latitude, i) AS zla, arg_max(longitude, i) AS zlo,
    sqrt(avg(pow({hav('latitude', 'longitude', 'clat', 'clon')}, 2))) AS rg, coalesce(sum(turn), 0.0) AS net, coalesce(sum(abs(turn)), 0.0) AS total
  FROM t4 GROUP BY 1),
rv0 AS (SELECT a.origin_id, a.i, min(b.i) AS j FROM tk a JOIN tk b ON a.origin_id = b.origin_id AND b.i >= a.i+2
    AND b.t_us-a.t_us >= 30000000 AND {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 25 GROUP BY 1, 2),
rv AS (SELECT v.origin_id, count(*) AS revisit_count, avg(duration_sec/((b.t_us-a.t_us)/1e6)) AS rcycles
  FROM rv0 v JOIN tk a ON a.origin_id = v.origin_id AND a.i = v.i JOIN tk b ON b.origin_id = v.origin_id AND b.i = v.j
  JOIN t5 ON t5.origin_id = v.origin_id GROUP BY 1),
t6 AS (SELECT t5.*, {hav('ala', 'alo', 'zla', 'zlo')} AS disp, path/greatest(duration_sec, 1.0) AS speed,
    coalesce(revisit_count, 0) AS revisit_count, abs(net)/360.0 AS rot,
    round(greatest(abs(net)/360.0, coalesce(rcycles, 0.0)), 2) AS cycles FROM t5 LEFT JOIN rv USING (origin_id)),
t7 AS (SELECT *, {unit('1-disp/greatest(path, 1e-3)')} AS closure FROM t6),
lp AS (SELECT *, CASE WHEN points < 6 OR gap > 300 THEN 'INSUFFICIENT_HISTORY' WHEN speed < 0.3 OR path < 35 THEN 'STATIONARY_JITTER'
    WHEN disp > 0.6*path OR rg > 250 THEN 'PROGRESSIVE_TRANSIT'
    WHEN duration_sec < 120 OR cycles < 1.3 THEN CASE WHEN closure >= 0.6 OR total >= 360 THEN 'SHORT_DETOUR' ELSE 'ORDINARY_TURN' END
    WHEN closure >= 0.6 AND (revisit_count >= 1 OR rot >= 1.2) THEN 'PERSISTENT_LOOP' ELSE 'COMPLEX_TRANSIT' END AS pattern FROM t7)"""


def tracks(spark, sf):
    r = adapter.readings(spark, sf).select("user_id", "event_id", "t_us", "latitude", "longitude", "accuracy_m")
    origins = r.select("user_id", F.col("event_id").alias("origin_id"), F.col("t_us").alias("origin_us"))
    return loops.trailing_tracks(r, origins)


def loop_rows(spark, sf):
    return loops.loop_evidence(tracks(spark, sf))


@query("lop1_loop_geometry", q(LOOPS, """SELECT origin_id, CASE WHEN points < 6 THEN 0.0 ELSE round(duration_sec, 1) END AS duration_sec,
  CASE WHEN pattern = 'INSUFFICIENT_HISTORY' THEN 0.0 ELSE round(path, 1) END AS path_distance_m,
  CASE WHEN pattern IN ('INSUFFICIENT_HISTORY', 'STATIONARY_JITTER') THEN 0.0 ELSE round(rg, 1) END AS radius_of_gyration_m,
  CASE WHEN pattern IN ('INSUFFICIENT_HISTORY', 'STATIONARY_JITTER') THEN 0.0 ELSE round(closure, 2) END AS closure_ratio,
  CASE WHEN pattern IN ('INSUFFICIENT_HISTORY', 'STATIONARY_JITTER') THEN 0.0 ELSE round(net, 1) + 0.0 END AS net_rotation_deg,
  CASE WHEN pattern IN ('INSUFFICIENT_HISTORY', 'STATIONARY_JITTER') THEN 0.0 ELSE round(total, 1) END AS total_angular_change_deg FROM lp"""))
def loop_geometry(spark, sf):
    cols = ["duration_sec", "path_distance_m", "radius_of_gyration_m", "closure_ratio", "net_rotation_deg", "total_angular_change_deg"]
    return loop_rows(spark, sf).select("origin_id", *[(F.col(c) + 0.0).alias(c) for c in cols])


@query("lop2_revisits", q(LOOPS, """SELECT origin_id, CASE WHEN pattern IN ('INSUFFICIENT_HISTORY', 'STATIONARY_JITTER') THEN 0 ELSE revisit_count END AS revisit_count,
  CASE WHEN pattern IN ('INSUFFICIENT_HISTORY', 'STATIONARY_JITTER') THEN 0.0 ELSE cycles END AS loop_cycles FROM lp"""))
def revisits(spark, sf):
    return loop_rows(spark, sf).select("origin_id", F.col("revisit_count").cast("bigint").alias("revisit_count"), "loop_cycles")


@query("lop3_loop_pattern", q(LOOPS, """SELECT origin_id, pattern, pattern = 'PERSISTENT_LOOP' AS is_looping,
  CASE WHEN pattern IN ('INSUFFICIENT_HISTORY', 'STATIONARY_JITTER') THEN 0.0 WHEN pattern = 'PROGRESSIVE_TRANSIT' THEN 0.1
    WHEN pattern IN ('SHORT_DETOUR', 'ORDINARY_TURN') THEN round(least(0.5, closure*0.5), 2)
    WHEN pattern = 'PERSISTENT_LOOP' THEN round(0.4*least(1.0, duration_sec/180.0)+0.3*least(1.0, cycles/2.0)+0.3*closure, 2)
    ELSE 0.4 END AS confidence FROM lp"""))
def loop_pattern(spark, sf):
    return loop_rows(spark, sf).select("origin_id", "pattern", "is_looping", "confidence")


# --- heart rate -----------------------------------------------------------------------------


def hr_base_sql(name: str, n_last: int, n_min: int, floor: float) -> str:
    return f""",
{name} AS (SELECT user_id, round(avg(b), 1) AS mean_bpm, round(greatest(stddev_pop(b), {floor}), 2) AS std_bpm, count(*) AS n,
  avg(b) AS xm, greatest(stddev_pop(b), {floor}) AS xs FROM (
  SELECT user_id, heart_rate_bpm AS b, row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) AS r
  FROM wearables WHERE wear_state = 'ON_WRIST') WHERE r <= {n_last} AND b BETWEEN 30 AND 250 GROUP BY 1 HAVING count(*) >= {n_min})"""


HEART = READINGS + hr_base_sql("hb", 500, 10, 3.0) + """,
hr0 AS (SELECT event_id, user_id, speed_mps, k % 11 <> 0 AS has_reading, CASE WHEN k % 13 = 0 THEN 300 ELSE 60 + v % 90 END AS bpm,
    CASE WHEN k % 5 = 0 THEN 'OFF_WRIST' ELSE 'ON_WRIST' END AS wear, CAST(k % 90 AS DOUBLE) AS age FROM readings),
hr AS (SELECT h.*, mean_bpm, std_bpm, n, CASE WHEN NOT has_reading THEN 'MISSING_DATA' WHEN wear <> 'ON_WRIST' THEN 'OFF_WRIST'
    WHEN bpm NOT BETWEEN 30 AND 250 THEN 'INVALID_READING' WHEN age > 60 THEN 'STALE_READING'
    WHEN n IS NULL THEN 'INSUFFICIENT_BASELINE' ELSE 'VALID' END AS hr_status,
    round((bpm-mean_bpm)/std_bpm, 2) + 0.0 AS z FROM hr0 h LEFT JOIN hb USING (user_id))"""


def heart_readings(spark, sf):
    r = adapter.readings(spark, sf)
    return r.select(
        "event_id", "user_id", "speed_mps", F.expr("k % 11 <> 0").alias("has_reading"),
        F.expr("CAST(CASE WHEN k % 13 = 0 THEN 300 ELSE 60 + v % 90 END AS INT)").alias("heart_rate_bpm"),
        F.expr("CASE WHEN k % 5 = 0 THEN 'OFF_WRIST' ELSE 'ON_WRIST' END").alias("wear_state"),
        F.col("t_us").alias("now_us"), F.expr("t_us - (k % 90) * 1000000").alias("reading_us"),
    )


@query("hrt1_heart_baseline", q(HEART, "SELECT user_id, mean_bpm AS baseline_mean_bpm, std_bpm AS baseline_std_bpm, n AS baseline_sample_count FROM hb"))
def heart_baseline(spark, sf):
    return heart.heart_baseline(adapter.wearables(spark, sf)).drop("exact_mean_bpm", "exact_std_bpm")


@query("hrt1_group_heart_baseline", q(READINGS + hr_base_sql("hb", 50, 5, 2.0), "SELECT user_id, round(xm, 6) AS exact_mean_bpm, round(xs, 6) AS exact_std_bpm, n AS baseline_sample_count FROM hb"))
def group_heart_baseline(spark, sf):
    b = heart.heart_baseline(adapter.wearables(spark, sf), heart.HeartRules.group())
    return rounded(b.select("user_id", "exact_mean_bpm", "exact_std_bpm", "baseline_sample_count"), 6, ["exact_mean_bpm", "exact_std_bpm"])


def heart_rows(spark, sf):
    return heart.heart_evidence(heart_readings(spark, sf), heart.heart_baseline(adapter.wearables(spark, sf)))


@query("hrt2_reading_status", q(HEART, "SELECT event_id, hr_status, age AS reading_age_sec FROM hr"))
def heart_status(spark, sf):
    return heart_rows(spark, sf).select("event_id", "hr_status", "reading_age_sec")


@query("hrt3_response_pattern", q(HEART, """SELECT event_id, CASE WHEN hr_status = 'VALID' THEN z END AS z_score,
  CASE WHEN hr_status <> 'VALID' THEN 'UNAVAILABLE' WHEN z < 2 THEN 'WITHIN_NORMAL_BASELINE' WHEN speed_mps < 0.8 THEN 'ELEVATED_UNUSUAL_RESTING'
    ELSE 'EXERTION_CONCORDANT' END AS response_pattern, hr_status = 'VALID' AND z >= 2 AND speed_mps < 0.8 AS is_corroborating_risk FROM hr"""))
def heart_pattern(spark, sf):
    r = heart_rows(spark, sf)
    return r.select("event_id", (F.col("z_score") + 0.0).alias("z_score"), "response_pattern", "is_corroborating_risk")


NOW_US = 1706659200000000  # 2024-01-31


@query("hrt4_latest_reading", q(READINGS, f"""SELECT user_id, max(t_us) AS t_us, arg_max(heart_rate_bpm, (t_us, event_id)) AS heart_rate_bpm,
  arg_max(wear_state, (t_us, event_id)) AS wear_state, round(greatest(({NOW_US}-max(t_us))/1e6, 0.0), 1) AS age_seconds,
  ({NOW_US}-max(t_us))/1e6 > 60 AS is_stale FROM wearables GROUP BY 1"""))
def latest_reading(spark, sf):
    r = heart.latest_readings(adapter.wearables(spark, sf), F.lit(NOW_US))
    return r.withColumn("heart_rate_bpm", F.col("heart_rate_bpm").cast("bigint"))


# --- decisions ------------------------------------------------------------------------------

MIXED = (
    "CASE k % 4 WHEN 0 THEN 'QUIESCENT' WHEN 1 THEN 'NORMAL_TRANSIT' WHEN 2 THEN 'SUSPICIOUS' ELSE 'CRITICAL' END AS risk_tier",
    "CAST(k AS DOUBLE) AS risk_score",
    "CASE v % 3 WHEN 0 THEN 'INSIDE_SAFE_AREA' WHEN 1 THEN 'OUTSIDE_SAFE_AREA' ELSE 'SAFE_AREA_UNAVAILABLE' END AS safe_area_state",
    "CASE (k+v) % 4 WHEN 0 THEN 'FAMILIAR_LOCATION' WHEN 1 THEN 'UNFAMILIAR_LOCATION' WHEN 2 THEN 'NO_HISTORY'"
    " ELSE 'INSUFFICIENT_EVIDENCE' END AS familiarity_state",
    "k % 7 = 0 AS is_looping",
    "v % 5 = 0 AS is_corroborating_risk",
)
MIX = ", ".join(MIXED)


@query(
    "dec1_contextual_decision",
    q(READINGS, f"""SELECT event_id, decision_state, CASE
      WHEN decision_state = 'LOOPING_WITH_PHYSIOLOGICAL_AROUSAL' OR decision_state = 'CRITICAL' THEN 'ALERT'
      WHEN decision_state = 'PERSISTENT_LOOPING' THEN CASE WHEN risk_tier = 'CRITICAL' THEN 'ALERT' ELSE 'WARNING' END
      WHEN decision_state = 'SUSPICIOUS' THEN 'WARNING'
      WHEN decision_state = 'OUTSIDE_SAFE_AREA' THEN CASE WHEN is_corroborating_risk THEN 'WARNING' ELSE 'ADVISORY' END
      WHEN decision_state = 'UNFAMILIAR_MOVEMENT' THEN 'ADVISORY' ELSE 'NORMAL' END AS severity_level,
      CASE decision_state WHEN 'LOOPING_WITH_PHYSIOLOGICAL_AROUSAL' THEN 'PERSISTENT LOOPING WITH PHYSIOLOGICAL AROUSAL'
        WHEN 'PERSISTENT_LOOPING' THEN 'PERSISTENT LOOPING DETECTED'
        WHEN 'CRITICAL' THEN CASE WHEN is_corroborating_risk THEN 'CRITICAL EXCURSION (PHYSIOLOGICAL AROUSAL)' ELSE 'CRITICAL KINEMATIC EXCURSION' END
        WHEN 'SUSPICIOUS' THEN CASE WHEN is_corroborating_risk THEN 'SUSPICIOUS MOVEMENT (PHYSIOLOGICAL AROUSAL)' ELSE 'SUSPICIOUS MOVEMENT PATTERN' END
        WHEN 'OUTSIDE_SAFE_AREA' THEN CASE WHEN is_corroborating_risk THEN 'OUTSIDE SAFE AREA (PHYSIOLOGICAL AROUSAL)' ELSE 'OUTSIDE SAFE AREA (NORMAL KINEMATICS)' END
        WHEN 'FAMILIAR_MOVEMENT' THEN 'FAMILIAR MOVEMENT' WHEN 'UNFAMILIAR_MOVEMENT' THEN 'UNFAMILIAR MOVEMENT (NORMAL KINEMATICS)'
        ELSE 'SAFE / NORMAL' END AS display_state
      FROM (SELECT *, CASE WHEN is_looping AND is_corroborating_risk THEN 'LOOPING_WITH_PHYSIOLOGICAL_AROUSAL' WHEN is_looping THEN 'PERSISTENT_LOOPING'
        WHEN risk_tier IN ('CRITICAL', 'SUSPICIOUS') THEN risk_tier WHEN safe_area_state = 'OUTSIDE_SAFE_AREA' THEN 'OUTSIDE_SAFE_AREA'
        WHEN safe_area_state = 'INSIDE_SAFE_AREA' THEN 'SAFE / NORMAL' WHEN familiarity_state = 'FAMILIAR_LOCATION' THEN 'FAMILIAR_MOVEMENT'
        WHEN familiarity_state = 'UNFAMILIAR_LOCATION' THEN 'UNFAMILIAR_MOVEMENT' ELSE 'SAFE / NORMAL' END AS decision_state
        FROM (SELECT event_id, {MIX} FROM readings))"""),
)
def contextual_decision(spark, sf):
    r = adapter.readings(spark, sf).selectExpr(
        "event_id", *MIXED,
        "10.0D AS distance_to_safe_boundary_m", "'home' AS matched_safe_area_name", "'a1' AS nearest_anchor_id",
    )
    return decision.decide(r).select("event_id", "decision_state", "severity_level", "display_state")


@query("dec2_model_tiers", q(READINGS, """SELECT event_id, round(p*100.0, 2) AS risk_score, CASE WHEN round(p*100.0, 2) < 35 THEN 'QUIESCENT' WHEN p < 0.52 THEN 'NORMAL_TRANSIT'
  WHEN round(p*100.0, 2) < 70 THEN 'SUSPICIOUS' ELSE 'CRITICAL' END AS risk_tier, CASE WHEN round(p*100.0, 2) < 35 THEN 0 WHEN p < 0.52 THEN 1
  WHEN round(p*100.0, 2) < 70 THEN 2 ELSE 3 END AS polling_tier FROM (SELECT event_id, (k*97+v) % 1001/1001.0e0 AS p FROM readings)"""))
def model_tiers(spark, sf):
    r = adapter.readings(spark, sf).selectExpr("event_id", "(k*97+v) % 1001/1001.0D AS p")
    t = decision.model_tiers(F.col("p"), F.lit(0.52))
    t["polling_tier"] = t["polling_tier"].cast("bigint")
    return r.select("event_id", *[c.alias(n) for n, c in t.items()])


SCORE = READINGS + """,
os0 AS (SELECT event_id, user_id, t_us, k, is_degraded, CASE WHEN is_degraded THEN CASE WHEN net_displacement_m > 50 THEN 75.0 WHEN net_displacement_m > 25 THEN 50.0 ELSE 15.0 END
    ELSE least(100.0, coalesce(CASE WHEN k % 4 <> 0 THEN (v % 101)::DOUBLE END, least(60.0, speed_mps*12.0))) END
    * CASE WHEN k % 6 = 0 THEN 0.8e0 ELSE 1.0e0 END AS raw FROM readings),
os1 AS (SELECT *, round(greatest(0.0, least(100.0, raw)), 1) AS risk_score FROM os0),
os AS (SELECT *, CASE WHEN risk_score <= 34 THEN 'QUIESCENT' WHEN risk_score <= 64 THEN 'NORMAL_TRANSIT' WHEN risk_score <= 84 THEN 'SUSPICIOUS' ELSE 'CRITICAL' END AS risk_tier FROM os1)"""


def operational(spark, sf):
    r = adapter.readings(spark, sf).withColumns({
        "pdr_tier": F.expr("CASE WHEN is_degraded THEN CASE WHEN net_displacement_m > 50 THEN 'UNTRACKED_DISPLACEMENT' WHEN net_displacement_m > 25 THEN 'ZONE_TRANSITION' ELSE 'INDOOR_PACING' END END"),
        "cell_multiplier": F.expr("CASE WHEN k % 6 = 0 THEN 0.8D END"),
        "model_score": F.expr("CASE WHEN k % 4 <> 0 THEN CAST(v % 101 AS DOUBLE) END"),
    })
    return decision.operational_score(r)


@query("dec3_operational_score", q(SCORE, "SELECT event_id, risk_score, risk_tier FROM os"))
def operational_score(spark, sf):
    return operational(spark, sf).select("event_id", "risk_score", "risk_tier")


@query("dec4_lead_time", q(SCORE, "SELECT event_id, CASE WHEN risk_tier IN ('SUSPICIOUS', 'CRITICAL') THEN round(greatest(240.0, 900.0-(risk_score-65.0)*15.0), 1) END AS lead_s FROM os"))
def lead_time(spark, sf):
    return operational(spark, sf).select("event_id", F.col("predicted_lead_time_sec").alias("lead_s"))


@query("dec5_polling_instruction", q(SCORE, """SELECT event_id, mode, CASE WHEN mode = 'PULSE' THEN 175 END AS sleep_seconds FROM (
  SELECT event_id, CASE WHEN risk_tier = 'CRITICAL' AND k < 5 THEN 'LAST_GASP' WHEN risk_tier = 'SUSPICIOUS' AND k < 15 THEN 'PULSE' ELSE 'CONTINUOUS' END AS mode FROM os)"""))
def polling(spark, sf):
    p = operational(spark, sf).select(
        "event_id", decision.polling_instruction(F.col("risk_tier"), F.col("battery_pct")).alias("p")
    )
    return p.select("event_id", "p.mode", F.col("p.sleep_seconds").cast("bigint").alias("sleep_seconds"))


@query("dec6_score_traces")
def score_traces(spark, sf):
    """Points to windows, features, model scores, movement class, spatial context and decision."""
    from tracewell.operators import models, risk
    from tracewell.operators.scoring import score_windows
    from tracewell.plans.risk_queries import _cohort, _fits

    f = store(feature_table(spark, sf, 250))
    fitted = _fits(spark, _cohort(f), models.fit_boosted)
    return score_windows(f, adapter.zones(spark, sf), place_profiles(spark, sf), fitted, risk.population_prior(risk.held_out(f)[0]))


SUMMARY = feat() + """,
sw AS (SELECT trajectory_id, window_id, end_us, h.horizon_s, round(100.0*path_distance_m/(path_distance_m+h.m), 2) AS risk_score
  FROM feat, (VALUES (120, 200.0e0), (360, 400.0e0)) h(horizon_s, m)),
sx AS (SELECT *, risk_score >= 50 AS binary_alert, CASE WHEN risk_score >= 70 THEN 'CRITICAL' ELSE 'SAFE / NORMAL' END AS decision_state FROM sw)"""


@query("dec7_trip_summary", q(SUMMARY, """SELECT trajectory_id, horizon_s, count(*) AS windows, count(*) FILTER (WHERE binary_alert) AS alerts_fired,
  max(risk_score) AS peak_score, arg_max(risk_score, (end_us, window_id)) AS current_score, arg_max(decision_state, (end_us, window_id)) AS last_decision_state
  FROM sx GROUP BY 1, 2"""))
def trip_summary(spark, sf):
    f = feature_table(spark, sf).select("trajectory_id", "window_id", "end_us", "path_distance_m")
    h = F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("horizon_s"), F.lit(b).alias("m")) for a, b in ((120, 200.0), (360, 400.0))])).alias("h")
    s = f.select("*", h).select("*", "h.*").withColumn("risk_score", F.expr("round(100.0D*path_distance_m/(path_distance_m+m), 2)"))
    s = s.selectExpr("*", "risk_score >= 50 AS binary_alert", "CASE WHEN risk_score >= 70 THEN 'CRITICAL' ELSE 'SAFE / NORMAL' END AS decision_state")
    return decision.trip_summary(s)


@query("dec8_top_features", q(OWN, """SELECT window_id, concat_ws(',', CASE WHEN max_mad_z_score IS NOT NULL THEN 'max_mad_z_score' END,
  CASE WHEN p95_exceedance_count IS NOT NULL THEN 'p95_exceedance_count' END, CASE WHEN mean_speed_mps IS NOT NULL THEN 'mean_speed_mps' END,
  CASE WHEN tortuosity_index IS NOT NULL THEN 'tortuosity_index' END) AS names,
  round(coalesce(round(max_mad_z_score, 3), 0)+coalesce(round(p95_exceedance_count, 3), 0)+coalesce(round(mean_speed_mps, 3), 0)+coalesce(round(tortuosity_index, 3), 0), 3) AS value_sum FROM judged"""))
def top_features(spark, sf):
    t = judged(spark, sf).select("window_id", decision.top_features().alias("t"))
    return t.select(
        "window_id", F.array_join("t.feature", ",").alias("names"),
        F.round(F.aggregate("t", F.lit(0.0), lambda a, s: a + s["value"]), 3).alias("value_sum"),
    )
