"""Queries over trips, anchors, baselines and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.config import BASELINE_FEATURES
from tracewell.functions import geo
from tracewell.operators import anchors, profiles, trips
from tracewell.plans import adapter
from tracewell.plans.registry import query, rnd, rounded
from tracewell.plans.sqltext import feat, hav, q
from tracewell.plans.window_queries import feature_table

TRIPS = feat() + """,
ends AS (
  SELECT user_id, trajectory_id, min(t_us) AS start_us, max(t_us) AS end_us,
    arg_min(latitude, (t_us, event_id)) AS start_lat, arg_min(longitude, (t_us, event_id)) AS start_lon,
    arg_max(latitude, (t_us, event_id)) AS end_lat, arg_max(longitude, (t_us, event_id)) AS end_lon
  FROM pts GROUP BY 1, 2),
trips AS (
  SELECT e.*, p.path_distance_m FROM ends e LEFT JOIN
    (SELECT trajectory_id, sum(path_distance_m) AS path_distance_m FROM feat GROUP BY 1) p USING (trajectory_id)),
endpoints AS (
  SELECT user_id, trajectory_id, start_us AS t_us, start_lat AS latitude, start_lon AS longitude,
    'start' AS endpoint_type, path_distance_m FROM trips
  UNION ALL SELECT user_id, trajectory_id, end_us, end_lat, end_lon, 'end', path_distance_m FROM trips)"""


def trip_table(spark, sf):
    return trips.trip_table(adapter.points(spark, sf), feature_table(spark, sf))


@query(
    "trp1_trip_table",
    q(TRIPS, """SELECT trajectory_id, start_us, end_us, round(start_lat, 6) AS start_lat,
      round(end_lon, 6) AS end_lon, round(path_distance_m, 4) AS path_distance_m FROM trips"""),
)
def trip_rows(spark, sf):
    t = trip_table(spark, sf)
    return t.select(
        "trajectory_id", geo.micros("start_time").alias("start_us"), geo.micros("end_time").alias("end_us"),
        F.round("start_lat", 6).alias("start_lat"), F.round("end_lon", 6).alias("end_lon"),
        F.round("path_distance_m", 4).alias("path_distance_m"),
    )


@query(
    "trp1_full_paths",
    q(feat(), f"""SELECT trajectory_id, round(coalesce(sum({hav('prev_lat', 'prev_lon', 'latitude', 'longitude')}), 0.0), 4)
      AS full_path_m FROM seg GROUP BY 1"""),
)
def full_paths(spark, sf):
    from tracewell.operators.segments import segment_points

    s = segment_points(adapter.points(spark, sf).drop("uid", "k", "v", "event_type", "event_id"))
    return rounded(trips.full_paths(s).drop("user_id"), 4, ["full_path_m"])


@query(
    "trp2_endpoint_table",
    q(TRIPS, """SELECT trajectory_id, t_us, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
      endpoint_type FROM endpoints"""),
)
def endpoint_rows(spark, sf):
    e = trips.endpoint_table(trip_table(spark, sf))
    return e.select(
        "trajectory_id", geo.micros("timestamp").alias("t_us"),
        F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "endpoint_type",
    )


DISP = hav("start_lat", "start_lon", "end_lat", "end_lon")
RETURNS = TRIPS + f""",
returns AS (SELECT * FROM (SELECT *, {DISP} AS endpoint_disp_m FROM trips)
  WHERE endpoint_disp_m <= 200 AND path_distance_m >= 200 AND path_distance_m >= 2*endpoint_disp_m)"""


@query("trp3_return_trips", q(RETURNS, "SELECT trajectory_id, round(endpoint_disp_m, 4) AS endpoint_disp_m FROM returns"))
def returning(spark, sf):
    return trips.return_trips(trip_table(spark, sf)).select(
        "trajectory_id", F.round("endpoint_disp_m", 4).alias("endpoint_disp_m")
    )


STAT = ["avg_return_trip_distance_m", "cv_return_trip_distance", "avg_step_speed_mps", "speed_std_dev"]


@query(
    "trp4_trip_statistics",
    q(
        RETURNS,
        f"""SELECT user_id, trip_count, return_trips, {rnd(STAT, 5)} FROM
        (SELECT user_id, count(*) AS trip_count FROM trips GROUP BY 1)
        LEFT JOIN (SELECT user_id, count(*) AS return_trips, avg(path_distance_m) AS avg_return_trip_distance_m,
          CASE WHEN count(*) >= 2 AND avg(path_distance_m) > 1e-9
            THEN stddev_samp(path_distance_m)/avg(path_distance_m) END AS cv_return_trip_distance
          FROM returns GROUP BY 1) USING (user_id)
        LEFT JOIN (SELECT user_id, avg(mean_speed_mps) AS avg_step_speed_mps,
          coalesce(stddev_samp(mean_speed_mps), 0.0) AS speed_std_dev FROM feat
          WHERE mean_speed_mps IS NOT NULL AND is_kinematically_evaluable AND NOT has_extreme_kinematic_transition
          GROUP BY 1) USING (user_id)""",
    ),
)
def statistics(spark, sf):
    return rounded(trips.trip_statistics(trip_table(spark, sf), feature_table(spark, sf)), 5, STAT)


@query(
    "trp5_max_radius_from_median_start",
    q(
        TRIPS,
        f""", r AS (SELECT user_id, median(start_lat) AS la, median(start_lon) AS lo FROM trips GROUP BY 1)
        SELECT user_id, round(max({hav('la', 'lo', 'latitude', 'longitude')}), 4) AS max_historical_radius_m
        FROM pts JOIN r USING (user_id) GROUP BY 1""",
    ).replace(")\n, r AS", "),\nr AS"),
)
def radius(spark, sf):
    p = adapter.points(spark, sf)
    refs = trips.reference_points(trips.trip_table(p))
    return rounded(trips.max_radius(p, refs), 4, ["max_historical_radius_m"])


@query(
    "trp6_distance_variation",
    q(TRIPS, """SELECT user_id, count(path_distance_m) AS n_trips, round(CASE WHEN count(path_distance_m) >= 2
      AND avg(path_distance_m) > 1e-9 THEN stddev_samp(path_distance_m)/avg(path_distance_m) END, 6) AS cv
      FROM trips GROUP BY 1"""),
)
def distance_variation(spark, sf):
    return rounded(trips.trip_variation(trip_table(spark, sf)), 6, ["cv"])


NEAR = hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")
CLUSTERS = TRIPS + f""",
e AS (SELECT *, row_number() OVER (ORDER BY t_us, trajectory_id, CASE endpoint_type WHEN 'end' THEN 0 ELSE 1 END) AS i
  FROM endpoints),
near AS (SELECT a.user_id, a.i AS a, b.i AS b FROM e a JOIN e b ON a.user_id = b.user_id AND {NEAR} <= 150),
core AS (SELECT a AS i FROM near GROUP BY 1 HAVING count(*) >= 3),
link AS (SELECT a, b FROM near WHERE a IN (SELECT i FROM core) AND b IN (SELECT i FROM core)),
reach AS (SELECT i AS a, i AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
label AS (SELECT a AS i, min(b) AS cluster FROM reach GROUP BY 1),
member AS (
  SELECT i, cluster FROM label
  UNION ALL SELECT n.a, min(l.cluster) FROM near n JOIN label l ON n.b = l.i
  WHERE n.a NOT IN (SELECT i FROM core) GROUP BY 1),
clustered AS (SELECT e.*, m.cluster FROM e JOIN member m USING (i))"""


def rq(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def clustered(spark, sf):
    return anchors.cluster_endpoints(trips.endpoint_table(trip_table(spark, sf)))


@query(
    "anc1_endpoint_clusters",
    rq(CLUSTERS, """SELECT c.trajectory_id, c.endpoint_type, f.t_us AS cluster_us, f.trajectory_id AS cluster_trip
      FROM clustered c JOIN e f ON c.cluster = f.i"""),
)
def endpoint_clusters(spark, sf):
    return clustered(spark, sf).select(
        "trajectory_id", "endpoint_type", geo.micros("cluster.timestamp").alias("cluster_us"),
        F.col("cluster.trajectory_id").alias("cluster_trip"),
    )


ANCHORS = CLUSTERS + f""",
ctr AS (SELECT user_id, cluster, avg(cos(radians(latitude))*cos(radians(longitude))) AS x,
  avg(cos(radians(latitude))*sin(radians(longitude))) AS y, avg(sin(radians(latitude))) AS z,
  min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS raw_endpoint_count FROM clustered GROUP BY 1, 2),
ctr2 AS (SELECT *, degrees(atan2(z, sqrt(x*x+y*y))) AS clat, degrees(atan2(y, x)) AS clon FROM ctr),
rad AS (SELECT cluster, greatest(25.0, quantile_cont({hav('clat', 'clon', 'latitude', 'longitude')}, 0.95)) AS radius_m,
  string_agg(DISTINCT CAST(t_us // 3600000000 % 24 AS VARCHAR), ',' ORDER BY CAST(t_us // 3600000000 % 24 AS VARCHAR)) AS hours
  FROM clustered JOIN ctr2 USING (user_id, cluster) GROUP BY 1),
lagged AS (SELECT *, lag(trajectory_id) OVER w AS pt, lag(endpoint_type) OVER w AS pe FROM clustered
  WINDOW w AS (PARTITION BY cluster ORDER BY t_us, trajectory_id, endpoint_type)),
vis AS (SELECT cluster, CAST(sum(CASE WHEN pt IS NULL THEN 1
    WHEN pt = trajectory_id THEN CASE WHEN path_distance_m >= 200 THEN 1 ELSE 0 END
    WHEN pe = 'end' AND endpoint_type = 'start' THEN 0 ELSE 1 END) AS BIGINT) AS observation_count
  FROM lagged GROUP BY 1),
anchors AS (SELECT user_id, clat, clon, first_us, last_us, raw_endpoint_count, radius_m, hours, observation_count,
  CASE WHEN observation_count >= 5 THEN 'CONFIRMED' ELSE 'PENDING_CAREGIVER_REVIEW' END AS status,
  user_id || '_anchor_' || (row_number() OVER (PARTITION BY user_id ORDER BY raw_endpoint_count DESC, cluster) - 1) AS anchor_id,
  row_number() OVER (PARTITION BY user_id ORDER BY raw_endpoint_count DESC, cluster) - 1 AS anchor_rank
  FROM ctr2 JOIN rad USING (cluster) JOIN vis USING (cluster))"""


def anchor_rows(spark, sf):
    return anchors.anchor_table(clustered(spark, sf))


@query(
    "anc2_anchor_geometry",
    rq(ANCHORS, """SELECT anchor_id, round(clat, 6) AS center_latitude, round(clon, 6) AS center_longitude,
      round(radius_m, 3) AS radius_m, first_us, last_us, hours FROM anchors"""),
)
def anchor_geometry(spark, sf):
    a = anchor_rows(spark, sf)
    hours = F.concat_ws(",", F.array_sort(F.transform("typical_hours", lambda h: h.cast("string"))))
    return a.select(
        "anchor_id", F.round("center_latitude", 6).alias("center_latitude"),
        F.round("center_longitude", 6).alias("center_longitude"), F.round("radius_m", 3).alias("radius_m"),
        geo.micros("first_seen").alias("first_us"), geo.micros("last_seen").alias("last_us"), hours.alias("hours"),
    )


@query("anc3_distinct_visits", rq(ANCHORS, "SELECT anchor_id, observation_count, raw_endpoint_count FROM anchors"))
def distinct_visits(spark, sf):
    return anchor_rows(spark, sf).select("anchor_id", "observation_count", "raw_endpoint_count")


@query("anc4_anchor_status", rq(ANCHORS, "SELECT anchor_id, status, anchor_rank FROM anchors"))
def anchor_status(spark, sf):
    return anchor_rows(spark, sf).select(
        "anchor_id", "status", F.col("anchor_rank").cast("bigint").alias("anchor_rank")
    )


@query("qry9_anchor_audit", rq(ANCHORS, f"""SELECT status, count(*) AS anchors, round(avg(radius_m), 3) AS mean_radius_m,
  round(median(radius_m), 3) AS median_radius_m, CAST(sum(observation_count) AS BIGINT) AS visits FROM anchors GROUP BY 1"""))
def anchor_audit(spark, sf):
    from tracewell.operators.serving import anchor_audit as audit

    return rounded(audit(anchor_rows(spark, sf)), 3, ["mean_radius_m", "median_radius_m"])


LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT user_id, '{c}' AS feature, {c} AS v FROM feat" for c in BASELINE_FEATURES
) + ")"
SPREAD = feat() + f""",
{LONG},
med AS (SELECT *, median(v) OVER (PARTITION BY user_id, feature) AS m FROM long WHERE v IS NOT NULL),
sp AS (SELECT user_id, feature, count(*) AS n, min(m) AS median, median(abs(v-m)) AS mad,
  1.4826*median(abs(v-m)) AS robust_scale, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99,
  avg(v) AS mean, var_samp(v) AS variance, min(v) AS lo FROM med GROUP BY 1, 2)"""
POP = f"""
pmed AS (SELECT *, median(v) OVER (PARTITION BY feature) AS m FROM long WHERE v IS NOT NULL),
pop AS (SELECT feature, count(*) AS n, min(m) AS median, median(abs(v-m)) AS mad,
  1.4826*median(abs(v-m)) AS robust_scale, quantile_cont(v, 0.95) AS p95 FROM pmed GROUP BY 1)"""


@query("bas1_mad_and_scale", q(SPREAD, f"SELECT user_id, feature, n AS sample_size, {rnd(['median', 'mad', 'robust_scale'], 5)} FROM sp"))
def mad_and_scale(spark, sf):
    from tracewell.functions.quantiles import spread
    from tracewell.operators.features import melt

    s = spread(melt(feature_table(spark, sf), ["user_id"], BASELINE_FEATURES), ["user_id", "feature"], "value")
    return rounded(s.select("user_id", "feature", "sample_size", "median", "mad", "robust_scale"), 5,
                   ["median", "mad", "robust_scale"])


FIT = ["p95", "p99", "mad", "robust_scale"]
GAMMA = "n < 30 AND lo > 0 AND coalesce(variance, 0) > 1e-9"


@query(
    "bas2_speed_baseline_fit",
    q(SPREAD, f"""SELECT user_id, n AS sample_size, CASE WHEN {GAMMA} THEN 'gamma' ELSE 'empirical' END AS distribution_type,
      round(CASE WHEN {GAMMA} THEN mean*mean/variance END, 4) AS gamma_shape_k,
      round(CASE WHEN {GAMMA} THEN variance/mean END, 5) AS gamma_scale_theta, {rnd(FIT, 5)}
      FROM sp WHERE feature = 'mean_speed_mps'"""),
)
def speed_fit(spark, sf):
    b = profiles.feature_baselines(feature_table(spark, sf)).where("feature = 'mean_speed_mps' AND sample_size > 0")
    b = b.select("user_id", "sample_size", "distribution_type", "gamma_shape_k", "gamma_scale_theta", *FIT)
    return rounded(rounded(b, 4, ["gamma_shape_k"]), 5, ["gamma_scale_theta", *FIT])


@query(
    "bas3_all_baseline_fits",
    q(SPREAD, f"""SELECT u.user_id, f.feature, coalesce(n, 0) AS sample_size,
      CASE WHEN n IS NULL THEN 'undefined' WHEN {GAMMA} THEN 'gamma' ELSE 'empirical' END AS distribution_type, {rnd(FIT, 5)}
      FROM (SELECT DISTINCT user_id FROM feat) u CROSS JOIN (SELECT DISTINCT feature FROM long) f
      LEFT JOIN sp ON sp.user_id = u.user_id AND sp.feature = f.feature"""),
)
def all_fits(spark, sf):
    b = profiles.feature_baselines(feature_table(spark, sf))
    return rounded(b.select("user_id", "feature", "sample_size", "distribution_type", *FIT), 5, FIT)


EMP = ["median", "mad", "robust_scale", "p95"]
EMP_SQL = ", ".join(f"round(CASE WHEN n >= 10 THEN {c} END, 5) + 0.0 AS {c}" for c in EMP)


@query("bas4_empirical_baseline", q(SPREAD, f"SELECT user_id, feature, n AS sample_size, {EMP_SQL} FROM sp"))
def empirical(spark, sf):
    return rounded(profiles.empirical_baselines(feature_table(spark, sf)), 5, EMP)


@query("bas5_population_prior", q(SPREAD + "," + POP, f"SELECT feature, n AS sample_size, {EMP_SQL} FROM pop"))
def population(spark, sf):
    return rounded(profiles.population_baseline(feature_table(spark, sf)), 5, EMP)


CUT_US = 1705276800000000  # 2024-01-15


@query(
    "bas6_as_of_windows",
    q(feat(), f"""SELECT user_id, count(*) AS windows, max(end_us) AS last_us FROM feat
      WHERE end_us <= {CUT_US} + CAST(user_id AS BIGINT) % 7 * 86400000000 GROUP BY 1"""),
)
def as_of_windows(spark, sf):
    f = feature_table(spark, sf)
    cut = adapter.users(spark, sf).select(
        F.col("uid").cast("string").alias("user_id"),
        geo.from_micros(F.expr(f"{CUT_US} + uid % 7 * 86400000000")).alias("as_of"),
    )
    return profiles.as_of(f, cut).groupBy("user_id").agg(
        F.count("*").alias("windows"), F.max("end_us").alias("last_us")
    )


@query(
    "bas7_chosen_baseline",
    q(
        SPREAD + "," + POP + ",\n tc AS (SELECT user_id, count(DISTINCT trajectory_id) AS t FROM pts GROUP BY 1)",
        """SELECT tc.user_id, pop.feature, round(CASE WHEN t >= 11 THEN CASE WHEN sp.n >= 10 THEN sp.median END ELSE pop.median END, 5) AS median,
        CASE WHEN t >= 11 THEN 'PERSONALIZED' ELSE 'COLD_START' END AS profile_mode,
        CASE WHEN t >= 11 THEN 'PERSONALIZED' ELSE 'POPULATION' END AS baseline_type,
        CASE WHEN t >= 11 THEN 'ML_DRIVEN' ELSE 'COLD_START' END AS cold_start_status,
        CASE WHEN t >= 11 THEN t ELSE 0 END AS trip_count
        FROM tc CROSS JOIN pop LEFT JOIN sp ON sp.user_id = tc.user_id AND sp.feature = pop.feature""",
    ),
)
def chosen(spark, sf):
    from tracewell.config import RiskRules

    f = feature_table(spark, sf)
    users = adapter.points(spark, sf).groupBy("user_id").agg(
        F.countDistinct("trajectory_id").alias("trip_count")
    ).withColumn("cold_start_status", F.lit(None).cast("string"))
    out = profiles.chosen_baselines(
        users, profiles.empirical_baselines(f), profiles.population_baseline(f), RiskRules(warmup_trips=11)
    )
    return rounded(out.select("user_id", "feature", "median", "profile_mode", "baseline_type", "cold_start_status", "trip_count"), 5, ["median"])


HISTORY = TRIPS + """,
h1 AS (SELECT *, row_number() OVER w AS trip_index,
    CASE WHEN count(*) OVER w >= 2 AND avg(path_distance_m) OVER w > 1e-9
      THEN stddev_samp(path_distance_m) OVER w / avg(path_distance_m) OVER w END AS cv
  FROM trips WHERE path_distance_m IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY start_us, trajectory_id ROWS UNBOUNDED PRECEDING)),
h2 AS (SELECT *, last_value(cv IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY trip_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pcv FROM h1),
h3 AS (SELECT *, CASE WHEN cv IS NOT NULL AND pcv IS NOT NULL THEN
    CASE WHEN pcv = 0 THEN CASE WHEN cv = 0 THEN 0.0 ELSE 'Infinity'::DOUBLE END ELSE abs(cv-pcv)/pcv END END AS delta_cv FROM h2),
h4 AS (SELECT *, trip_index - coalesce(max(CASE WHEN NOT coalesce(delta_cv < 0.05, false) THEN trip_index END)
    OVER (PARTITION BY user_id ORDER BY trip_index ROWS UNBOUNDED PRECEDING), 0) AS consecutive_stable_trips FROM h3),
history AS (SELECT *, CASE WHEN max(CASE WHEN trip_index >= 7 AND consecutive_stable_trips >= 3 THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY trip_index ROWS UNBOUNDED PRECEDING) = 1
    THEN 'ML_DRIVEN' ELSE 'RULE_BASED_FALLBACK' END AS status FROM h4)"""


@query(
    "prf1_cold_start_history",
    q(HISTORY, "SELECT user_id, trip_index, trajectory_id, round(cv, 6) AS cv, round(delta_cv, 5) AS delta_cv, consecutive_stable_trips, status FROM history"),
)
def history(spark, sf):
    h = profiles.stability_history(trip_table(spark, sf)).drop("path_distance_m")
    return rounded(rounded(h, 6, ["cv"]), 5, ["delta_cv"])


@query(
    "prf1_cold_start_status",
    q(HISTORY, """SELECT user_id, arg_max(status, trip_index) AS cold_start_status,
      arg_max(consecutive_stable_trips, trip_index) AS consecutive_stable_trips,
      round(arg_max(delta_cv, trip_index) FILTER (WHERE delta_cv IS NOT NULL), 5) AS delta_cv,
      count(*) AS trips_with_path FROM history GROUP BY 1"""),
)
def final_status(spark, sf):
    return rounded(profiles.cold_start_status(profiles.stability_history(trip_table(spark, sf))), 5, ["delta_cv"])


@query(
    "prf2_quarantine",
    q(
        SPREAD,
        """SELECT user_id, count(*) AS total_observations,
        count(*) FILTER (WHERE e OR b OR o) AS quarantined_observations,
        count(*) FILTER (WHERE e) AS extreme_kinematic_transition, count(*) FILTER (WHERE b) AS unphysical_speed_burst,
        count(*) FILTER (WHERE o) AS personal_mad_speed_outlier,
        round(100.0*count(*) FILTER (WHERE e OR b OR o)/count(*), 4) AS quarantine_percentage
        FROM (SELECT f.user_id, has_extreme_kinematic_transition AS e, coalesce(mean_speed_mps > 340, false) AS b,
          coalesce(robust_scale > 0 AND mean_speed_mps > greatest(median + 5*robust_scale, 300), false) AS o
          FROM feat f LEFT JOIN sp ON sp.user_id = f.user_id AND sp.feature = 'mean_speed_mps') GROUP BY 1""",
    ),
)
def quarantined(spark, sf):
    return profiles.quarantine(feature_table(spark, sf))


@query("prf3_user_profiles")
def user_profiles(spark, sf):
    return profiles.user_profiles(adapter.points(spark, sf), feature_table(spark, sf))


@query("snk5_profile_json")
def profile_json(spark, sf):
    return profiles.profile_json(
        profiles.user_profiles(adapter.points(spark, sf), feature_table(spark, sf))
    )


@query(
    "qry11_profile_audit",
    q(HISTORY, """SELECT status AS cold_start_status, count(*) AS users FROM (
      SELECT arg_max(status, trip_index) AS status FROM history GROUP BY user_id) GROUP BY 1"""),
)
def profile_audit(spark, sf):
    s = profiles.cold_start_status(profiles.stability_history(trip_table(spark, sf)))
    return s.groupBy("cold_start_status").agg(F.count("*").alias("users"))


@query(
    "qry11_baseline_audit",
    q(SPREAD, f"""SELECT feature, distribution_type, count(*) AS fits, CAST(sum(n) AS BIGINT) AS samples FROM (
      SELECT f.feature, coalesce(n, 0) AS n,
      CASE WHEN n IS NULL THEN 'undefined' WHEN {GAMMA} THEN 'gamma' ELSE 'empirical' END AS distribution_type
      FROM (SELECT DISTINCT user_id FROM feat) u CROSS JOIN (SELECT DISTINCT feature FROM long) f
      LEFT JOIN sp ON sp.user_id = u.user_id AND sp.feature = f.feature) GROUP BY 1, 2"""),
)
def baseline_audit(spark, sf):
    b = profiles.feature_baselines(feature_table(spark, sf))
    return b.groupBy("feature", "distribution_type").agg(
        F.count("*").alias("fits"), F.sum("sample_size").alias("samples")
    )


@query("prf4_history_profile")
def history_profile(spark, sf):
    p = adapter.points(spark, sf)
    current = p.groupBy("user_id").agg(
        F.max_by("trajectory_id", "timestamp").alias("trajectory_id")
    )
    starts = p.groupBy("trajectory_id").agg(F.min("timestamp").alias("as_of"))
    summary, base = profiles.history_profiles(p, current.join(starts, "trajectory_id"))
    return summary.join(base, "user_id").select(
        "user_id", "trip_count", "windows", "profile_mode", "feature", "sample_size", "median", "p95"
    )


@query(
    "flagship_user_movement",
    q(feat(), """SELECT user_id, count(*) AS windows, round(median(path_distance_m), 4) AS median_path_m,
      round(avg(mean_speed_mps), 5) AS mean_speed_mps,
      round(count(*) FILTER (WHERE is_kinematically_evaluable)/count(*)::DOUBLE, 6) AS usable_share
      FROM feat GROUP BY 1"""),
)
def flagship(spark, sf):
    from tracewell.functions.quantiles import percentiles
    from tracewell.session import store

    f = store(
        feature_table(spark, sf).select(
            "user_id", "path_distance_m", "mean_speed_mps", "is_kinematically_evaluable"
        )
    )
    mid = percentiles(f, ["user_id"], "path_distance_m", [0.5])
    rest = f.groupBy("user_id").agg(
        F.count("*").alias("windows"),
        F.round(F.avg("mean_speed_mps"), 5).alias("mean_speed_mps"),
        F.round(F.count_if("is_kinematically_evaluable") / F.count("*"), 6).alias("usable_share"),
    )
    return rest.join(mid, "user_id").select(
        "user_id", "windows", F.round(F.col("q")[0], 4).alias("median_path_m"), "mean_speed_mps", "usable_share"
    )
