"""SQL fragments shared by the oracles: the same formulas as the adapter and the operators."""

from __future__ import annotations

TRIP_US = 259_200_000_000


def hav(a: str, b: str, c: str, d: str) -> str:
    h = (
        f"least(1.0, greatest(0.0, pow(sin(radians(({c})-({a}))/2),2)"
        f"+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2),2)))"
    )
    return f"(2*6371000.0*atan2(sqrt({h}), sqrt(1-({h}))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    east = f"sin(radians(({d})-({b})))*cos(radians({c}))"
    north = (
        f"cos(radians({a}))*sin(radians({c}))"
        f"-sin(radians({a}))*cos(radians({c}))*cos(radians(({d})-({b})))"
    )
    return f"fmod(degrees(atan2({east}, {north}))+360.0, 360.0)"


def unit(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


BASE = """base AS (
  SELECT event_id, user_id AS uid, epoch_us(ts) AS us,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CAST(round(value*100) AS BIGINT) AS v, event_type
  FROM events)"""


def pts(squeeze: int = 1000) -> str:
    return BASE + f""",
pts AS (
  SELECT event_id, uid, CAST(uid AS VARCHAR) AS user_id,
    uid || '_' || (us // {TRIP_US}) AS trajectory_id,
    (us - us % {TRIP_US}) + (us % {TRIP_US}) // {squeeze} AS t_us,
    39.9e0 + CAST(uid % 40 AS DOUBLE)*0.01e0 + CAST(k-50 AS DOUBLE)*0.00002e0 AS latitude,
    116.3e0 + CAST(uid % 25 AS DOUBLE)*0.01e0 + CAST((v % 100)-50 AS DOUBLE)*0.00002e0 AS longitude,
    k, v, event_type
  FROM base)"""


def seg(squeeze: int = 1000) -> str:
    return pts(squeeze) + """,
s1 AS (
  SELECT *, lag(t_us) OVER w AS prev_us, lag(latitude) OVER w AS prev_lat,
    lag(longitude) OVER w AS prev_lon
  FROM pts WINDOW w AS (PARTITION BY trajectory_id ORDER BY t_us, event_id)),
s2 AS (
  SELECT *, CASE WHEN t_us - prev_us > 300000000 THEN 1 ELSE 0 END AS opens,
    coalesce((t_us - prev_us)/1e6, 0.0) AS dt FROM s1),
s3 AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY trajectory_id ORDER BY t_us, event_id
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_index FROM s2),
s4 AS (
  SELECT *, min(t_us) OVER g AS seg0, max(t_us) OVER g AS seg1 FROM s3
  WINDOW g AS (PARTITION BY trajectory_id, segment_index)),
seg AS (
  SELECT *, (t_us - seg0) // 120000000 AS window_index,
    printf('%s_s%03d', trajectory_id, segment_index) AS segment_id,
    row_number() OVER (PARTITION BY trajectory_id, segment_index ORDER BY t_us, event_id) AS seg_rn
  FROM s4)"""


def win(squeeze: int = 1000) -> str:
    return seg(squeeze) + """,
win AS (
  SELECT user_id, trajectory_id, segment_index, segment_id, window_index,
    printf('%s_w%04d', segment_id, window_index) AS window_id,
    min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS point_count,
    min(seg0) AS seg0, min(seg1) AS seg1,
    (window_index < (min(seg1)-min(seg0))//120000000)
      OR (min(seg1)-min(seg0) = ((min(seg1)-min(seg0))//120000000 + 1)*120000000) AS is_full
  FROM seg GROUP BY 1,2,3,4,5)"""


def feat(squeeze: int = 1000) -> str:
    octs = ", ".join(
        f"count(*) FILTER (WHERE CAST(floor(bearing/45.0) AS BIGINT) % 8 = {i}) AS o{i}"
        for i in range(8)
    )
    ent = "+".join(
        f"CASE WHEN o{i}>0 THEN -(o{i}/n_b::DOUBLE)*log2(o{i}/n_b::DOUBLE) ELSE 0.0 END"
        for i in range(8)
    )
    return win(squeeze) + f""",
f1 AS (
  SELECT *, row_number() OVER (PARTITION BY trajectory_id, segment_index, window_index
    ORDER BY t_us, event_id) AS rn FROM seg),
f2 AS (
  SELECT *, CASE WHEN rn > 1 THEN dt END AS wdt,
    CASE WHEN rn > 1 THEN {hav('prev_lat', 'prev_lon', 'latitude', 'longitude')} END AS step,
    cos(radians(latitude))*cos(radians(longitude)) AS ux,
    cos(radians(latitude))*sin(radians(longitude)) AS uy, sin(radians(latitude)) AS uz
  FROM f1),
f3 AS (
  SELECT *, CASE WHEN wdt > 0 THEN step/wdt END AS speed, CASE WHEN wdt > 0 THEN wdt END AS sdt,
    CASE WHEN step >= 0.5 THEN {bearing('prev_lat', 'prev_lon', 'latitude', 'longitude')} END AS bearing
  FROM f2),
f4 AS (
  SELECT *, last_value(speed IGNORE NULLS) OVER b AS ps, last_value(sdt IGNORE NULLS) OVER b AS pd,
    last_value(bearing IGNORE NULLS) OVER b AS pb,
    avg(ux) OVER g AS cx, avg(uy) OVER g AS cy, avg(uz) OVER g AS cz
  FROM f3 WINDOW
    b AS (PARTITION BY trajectory_id, segment_index, window_index ORDER BY t_us, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    g AS (PARTITION BY trajectory_id, segment_index, window_index)),
f5 AS (
  SELECT *, degrees(atan2(cz, sqrt(cx*cx+cy*cy))) AS clat, degrees(atan2(cy, cx)) AS clon,
    (speed-ps)/(0.5*(sdt+pd)) AS acc,
    abs(fmod(bearing-pb+540.0, 360.0)-180.0) AS turn
  FROM f4),
f6 AS (
  SELECT user_id, trajectory_id, segment_index, segment_id, window_index,
    count(*) AS point_count, min(t_us) AS start_us, max(t_us) AS end_us, min(seg0) AS segment_start_us,
    min(seg1) AS seg1,
    count(wdt) AS n_steps, count(*) FILTER (WHERE wdt = 0) AS zero_dt_count,
    avg(wdt) AS dt_mean, median(wdt) AS dt_median, min(wdt) AS dt_min, max(wdt) AS dt_max,
    stddev_samp(wdt) AS dt_std, coalesce(sum(step), 0.0) AS path_distance_m,
    avg(step) AS step_distance_mean, median(step) AS step_distance_median,
    max(step) AS step_distance_max, min(step) AS step_distance_min,
    stddev_samp(step) AS step_distance_std,
    arg_min(latitude, rn) AS a_lat, arg_min(longitude, rn) AS a_lon,
    arg_max(latitude, rn) AS end_latitude, arg_max(longitude, rn) AS end_longitude,
    sqrt(avg(pow({hav('latitude', 'longitude', 'clat', 'clon')}, 2))) AS rg,
    min(latitude) AS lat0, max(latitude) AS lat1, min(longitude) AS lon0, max(longitude) AS lon1,
    min(clat) AS centroid_lat, min(clon) AS centroid_lon, count(speed) AS n_speeds,
    avg(speed) AS mean_speed_mps, median(speed) AS median_speed_mps, max(speed) AS max_speed_mps,
    min(speed) AS min_speed_mps, stddev_samp(speed) AS speed_std_dev,
    var_samp(speed) AS speed_variance,
    count(*) FILTER (WHERE speed > 340) AS extreme_transition_count,
    avg(acc) AS mean_acceleration_mps2, max(acc) AS max_acceleration_mps2,
    min(acc) AS min_acceleration_mps2, stddev_samp(acc) AS acceleration_std_dev,
    count(bearing) AS n_b, avg(cos(radians(bearing))) AS cb, avg(sin(radians(bearing))) AS sb,
    count(turn) AS n_turns, avg(turn) AS heading_change_mean, stddev_samp(turn) AS heading_change_std,
    count(*) FILTER (WHERE turn >= 30) AS sharp, count(*) FILTER (WHERE turn >= 135) AS reversals,
    {octs}
  FROM f5 GROUP BY 1,2,3,4,5),
f7 AS (
  SELECT *, printf('%s_w%04d', segment_id, window_index) AS window_id,
    (end_us-start_us)/1e6 AS temporal_span_sec,
    (window_index < (seg1-segment_start_us)//120000000)
      OR (seg1-segment_start_us = ((seg1-segment_start_us)//120000000+1)*120000000) AS is_full_window,
    {hav('a_lat', 'a_lon', 'end_latitude', 'end_longitude')} AS straight_line_displacement_m,
    CASE WHEN n_steps > 0 THEN zero_dt_count/n_steps::DOUBLE ELSE 0.0 END AS zero_dt_fraction,
    CASE WHEN point_count > 1 AND rg >= 1e-6 THEN rg ELSE 0.0 END AS radius_of_gyration,
    {hav('lat0', 'centroid_lon', 'lat1', 'centroid_lon')} AS bbox_height_m,
    {hav('centroid_lat', '0.0', 'centroid_lat', 'lon1-lon0')} AS bbox_width_m,
    extreme_transition_count > 0 AS has_extreme_kinematic_transition,
    CASE WHEN n_speeds > 0 THEN extreme_transition_count/n_speeds::DOUBLE ELSE 0.0 END
      AS extreme_transition_fraction,
    CASE WHEN n_b >= 2 THEN sharp/greatest((end_us-start_us)/1e6/60.0, 1/60.0) END AS turn_frequency,
    CASE WHEN n_b >= 2 THEN reversals/n_turns::DOUBLE END AS backtracking_tendency,
    CASE WHEN n_b >= 2 THEN {unit('1-sqrt(cb*cb+sb*sb)')} END AS heading_variability,
    CASE WHEN n_b >= 3 THEN ({ent})/3.0 END AS entropy_directional
  FROM f6),
f8 AS (
  SELECT *, sqrt(bbox_height_m*bbox_height_m+bbox_width_m*bbox_width_m) AS bbox_diagonal_m,
    bbox_height_m*bbox_width_m AS bbox_area_sqm,
    CASE WHEN point_count > 1 AND straight_line_displacement_m >= 1
      THEN path_distance_m/straight_line_displacement_m END AS tortuosity_index,
    CASE WHEN point_count >= 3 AND path_distance_m >= 10
      THEN {unit('1-straight_line_displacement_m/path_distance_m')} END AS path_closure_ratio
  FROM f7),
feat AS (
  SELECT *, backtracking_tendency*path_closure_ratio AS pacing_tendency,
    CASE WHEN n_b >= 2 AND bbox_diagonal_m >= 1 THEN path_closure_ratio
      *(least(bbox_width_m, bbox_height_m)/greatest(bbox_width_m, bbox_height_m, 1.0))
      *(1-backtracking_tendency) END AS loop_metric,
    CASE WHEN point_count >= 3 AND bbox_diagonal_m >= 1
      THEN radius_of_gyration/bbox_diagonal_m END AS spatial_randomness_dispersion,
    point_count > 1 AND path_distance_m > 0 AS has_displacement,
    mean_speed_mps IS NOT NULL AS has_valid_kinematics,
    mean_acceleration_mps2 IS NOT NULL AS has_acceleration,
    heading_change_mean IS NOT NULL AS has_valid_turns,
    entropy_directional IS NOT NULL AS has_entropy,
    point_count >= 3 AND temporal_span_sec >= 10 AND path_distance_m >= 1
      AS is_kinematically_evaluable
  FROM f8)"""


def beh(squeeze: int = 1000) -> str:
    c, b, lo = "coalesce(path_closure_ratio,0)", "coalesce(backtracking_tendency,0)", "coalesce(loop_metric,0)"
    e, hv = "coalesce(entropy_directional,0)", "coalesce(heading_variability,0)"
    tf, tm = "coalesce(turn_frequency,0)", "coalesce(heading_change_mean,0)"
    aspect = "(least(bbox_width_m,bbox_height_m)/greatest(bbox_width_m,bbox_height_m,1.0))"
    exp = "(path_distance_m/greatest(bbox_diagonal_m,1.0))"
    ratio = "(straight_line_displacement_m/greatest(path_distance_m,1.0))"
    def conf(x: str) -> str:
        return f"CASE WHEN behavior_class='INSUFFICIENT_EVIDENCE' THEN 0.0 ELSE round({unit(x)},4) END"
    return feat(squeeze) + f""",
b1 AS (
  SELECT *, CASE
    WHEN NOT is_kinematically_evaluable OR path_distance_m < 10 OR bbox_diagonal_m < 10
      OR has_extreme_kinematic_transition OR path_closure_ratio IS NULL THEN 'INSUFFICIENT_EVIDENCE'
    WHEN {c} >= 0.6 AND {exp} >= 1.8 AND {b} >= 0.01 AND {e} <= 0.7 THEN 'PACING'
    WHEN {c} >= 0.6 AND {lo} >= 0.45 AND {aspect} >= 0.2 AND {b} <= 0.05 AND {tm} <= 60 THEN 'LAPPING'
    WHEN {e} >= 0.7 AND {hv} >= 0.5 AND ({tf} >= 5 OR {tm} >= 45) AND {lo} <= 1 THEN 'RANDOM_DRIFT'
    ELSE 'NORMAL' END AS behavior_class FROM feat),
beh AS (
  SELECT *, {conf(f'0.6*{ratio}+0.4*(1-{hv})')} AS normal_confidence,
    {conf(f"0.4*{c}+0.3*{unit(f'({exp}-1)/3.0')}+0.3*{unit(f'{b}/0.1')}")} AS pacing_confidence,
    {conf(f"0.5*{lo}+0.3*{c}+0.2*{unit(f'1-{b}/0.1')}")} AS lapping_confidence,
    {conf(f"0.4*{e}+0.3*{hv}+0.3*{unit(f'{tm}/90.0')}")} AS random_drift_confidence
  FROM b1)"""


RAW = pts(250) + """,
faulty AS (
  SELECT user_id, trajectory_id,
    CASE WHEN k = 17 THEN NULL WHEN k = 19 THEN 946684800000000
      ELSE t_us // 1000000 * 1000000 END AS t_us,
    CASE WHEN k = 7 THEN NULL WHEN k = 13 THEN 95.0e0 ELSE latitude END AS latitude,
    longitude, CASE WHEN k % 10 = 0 THEN -777.0e0 ELSE CAST(v AS DOUBLE) END AS altitude, k,
    event_id AS pos
  FROM pts),
raw AS (
  SELECT * FROM faulty
  UNION ALL SELECT * REPLACE (pos + 1000000000 AS pos) FROM faulty WHERE k % 11 = 0
  UNION ALL SELECT * REPLACE (altitude + 1 AS altitude, pos + 2000000000 AS pos) FROM faulty WHERE k % 9 = 0),
reasons AS (
  SELECT *, CASE WHEN t_us IS NULL THEN 'unparseable_timestamp'
    WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_coordinates'
    WHEN latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180 THEN 'invalid_coordinates'
    WHEN t_us < 1104537600000000 THEN 'unset_clock' END AS reason FROM raw),
good AS (SELECT * FROM reasons WHERE reason IS NULL),
once AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, trajectory_id, t_us, latitude, longitude,
    altitude, k ORDER BY pos) AS copy FROM good),
near AS (
  SELECT *, row_number() OVER (PARTITION BY trajectory_id, t_us, latitude, longitude
    ORDER BY pos) AS repeat FROM once WHERE copy = 1),
tidy AS (
  SELECT *, row_number() OVER (PARTITION BY trajectory_id, t_us ORDER BY pos) - 1 AS subsecond_seq,
    count(*) OVER (PARTITION BY trajectory_id, t_us) > 1 AS timestamp_collision
  FROM near WHERE repeat = 1)"""

READINGS = pts() + """,
readings AS (
  SELECT *, 5.0e0 + k % 30 AS accuracy_m, k % 8 = 0 AS is_degraded,
    CAST(v % 80 AS DOUBLE) AS net_displacement_m, (v % 60)/10.0e0 AS speed_mps, k AS battery_pct
  FROM pts),
wearables AS (
  SELECT event_id, user_id, t_us, 60 + v % 90 AS heart_rate_bpm,
    CASE WHEN k % 5 = 0 THEN 'OFF_WRIST' ELSE 'ON_WRIST' END AS wear_state
  FROM pts WHERE event_type IN ('click', 'view')),
users AS (SELECT DISTINCT uid FROM pts),
consent AS (
  SELECT CAST(uid AS VARCHAR) AS user_id, uid % 10 <> 0 AS guardian_granted,
    uid % 3 = 0 AS end_user_consent_applicable,
    CASE WHEN uid % 4 = 0 THEN NULL ELSE uid % 5 <> 1 END AS end_user_granted FROM users),
zones AS (
  SELECT CAST(uid AS VARCHAR) AS user_id, 'c' || uid AS zone_id, 'home' AS name, 'CIRCLE' AS geometry_type,
    39.9e0 + CAST(uid % 40 AS DOUBLE)*0.01e0 AS center_lat,
    116.3e0 + CAST(uid % 25 AS DOUBLE)*0.01e0 AS center_lng,
    CASE WHEN uid % 17 = 0 THEN 0.0e0 ELSE 60.0e0 + uid % 60 END AS radius_m,
    uid % 7 <> 0 AS is_enabled FROM users
  UNION ALL
  SELECT CAST(uid AS VARCHAR), 'p' || uid, 'garden', 'POLYGON', NULL, NULL, NULL, true
  FROM users WHERE uid % 2 = 0)"""


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
