"""Queries over raw fixes: sources, cleaning rules and the quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import geo
from tracewell.functions.quantiles import distribution
from tracewell.operators import cleaning
from tracewell.plans import adapter
from tracewell.plans.registry import query, rounded
from tracewell.plans.sqltext import RAW, READINGS, bearing, hav, pts, q
from tracewell.sources import plt
from tracewell.session import scratch_dir

def clock():
    return geo.micros("timestamp").alias("t_us")


def _traces(spark, sf):
    root = scratch_dir(spark)
    plt.write_traces(adapter.raw_points(spark, sf), root)
    return root


@query("src1_discovered_traces", q(RAW, "SELECT DISTINCT user_id, trajectory_id FROM raw"))
def discovered(spark, sf):
    return plt.discover(spark, _traces(spark, sf)).select("user_id", "trajectory_id")


@query("src2_traces_read_back", q(RAW, """SELECT user_id, trajectory_id, pos, t_us, latitude, longitude, altitude FROM (
  SELECT *  REPLACE (5 + row_number() OVER (PARTITION BY trajectory_id ORDER BY pos) AS pos) FROM raw)
WHERE latitude IS NOT NULL"""))
def read_back(spark, sf):
    raw = plt.read_traces(spark, _traces(spark, sf))
    return raw.select("user_id", "trajectory_id", "pos", clock(), "latitude", "longitude", "altitude")


@query(
    "src3_altitude_metres",
    q(RAW, "SELECT pos, CASE WHEN altitude <> -777 THEN round(altitude*0.3048, 1) END AS altitude_m FROM raw"),
)
def altitude(spark, sf):
    return adapter.raw_points(spark, sf).select(
        "pos", plt.altitude_metres("altitude").alias("altitude_m")
    )


@query(
    "src4_column_scan",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 20",
)
def scan(spark, sf):
    return (
        adapter.table(spark, sf, "events")
        .where("event_type = 'click' AND value > 20")
        .select("event_id", "user_id", "value")
    )


@query(
    "src6_zone_and_consent_read",
    q(
        READINGS,
        """SELECT z.user_id, z.zone_id, z.geometry_type, round(z.radius_m, 3) AS radius_m, c.guardian_granted
        FROM zones z JOIN consent c USING (user_id) WHERE z.is_enabled""",
    ),
)
def zone_read(spark, sf):
    z = adapter.zones(spark, sf).where("is_enabled")
    return z.join(adapter.consent(spark, sf), "user_id").select(
        "user_id", "zone_id", "geometry_type", F.round("radius_m", 3).alias("radius_m"),
        "guardian_granted",
    )


@query("snk1_partitioned_parquet", q(pts(), """SELECT user_id, count(*) AS n_points,
  round(avg(latitude), 6) AS mean_lat FROM pts GROUP BY 1"""))
def write_parquet(spark, sf):
    path = scratch_dir(spark)
    p = adapter.points(spark, sf).select(
        "user_id", "trajectory_id", "timestamp", "latitude", "longitude",
        F.to_date("timestamp").alias("day"),
    )
    p.write.partitionBy("day").option("compression", "snappy").parquet(path)
    return spark.read.parquet(path).groupBy("user_id").agg(
        F.count("*").alias("n_points"), F.round(F.avg("latitude"), 6).alias("mean_lat")
    )


@query(
    "snk6_quality_report",
    q(
        RAW,
        """SELECT (SELECT count(*) FROM raw) AS total_raw_points, count(*) AS total_clean_points,
        count(DISTINCT user_id) AS users, count(DISTINCT trajectory_id) AS trajectories,
        count(*) FILTER (WHERE subsecond_seq > 0) AS preserved_same_second,
        min(latitude) AS min_latitude, max(latitude) AS max_latitude,
        min(longitude) AS min_longitude, max(longitude) AS max_longitude,
        min(t_us) AS earliest_us, max(t_us) AS latest_us,
        (SELECT count(*) FROM (SELECT t_us - lag(t_us) OVER (PARTITION BY trajectory_id
          ORDER BY t_us, subsecond_seq) AS d FROM tidy) WHERE d = 0) AS zero_dt_transitions,
        (SELECT max(s) FROM (SELECT (max(t_us)-min(t_us))/1e6 AS s FROM tidy GROUP BY trajectory_id)) AS longest_trip_s
        FROM tidy""",
    ),
)
def quality(spark, sf):
    r = cleaning.quality_report(adapter.raw_points(spark, sf))
    return (
        r.withColumn("earliest_us", geo.micros("earliest"))
        .withColumn("latest_us", geo.micros("latest"))
        .drop("earliest", "latest")
    )


def _reason(name: str, reasons: str) -> None:
    @query(
        name,
        q(RAW, f"SELECT reason, count(*) AS n FROM reasons WHERE reason IN ({reasons}) GROUP BY 1"),
    )
    def removed(spark, sf):
        tagged = adapter.raw_points(spark, sf).withColumn("reason", cleaning.removal_reason())
        return (
            tagged.where(f"reason IN ({reasons})")
            .groupBy("reason")
            .agg(F.count("*").alias("n"))
        )


_reason("cln1_missing_fields", "'unparseable_timestamp', 'missing_coordinates'")
_reason("cln2_out_of_bounds", "'invalid_coordinates'")
_reason("cln3_unset_clock", "'unset_clock'")

CLEAN_COLUMNS = "trajectory_id, t_us, latitude, longitude, altitude, pos"


@query("cln4_exact_duplicates", q(RAW, f"SELECT {CLEAN_COLUMNS} FROM once WHERE copy = 1"))
def exact(spark, sf):
    good = cleaning.valid_fixes(adapter.raw_points(spark, sf))
    return cleaning.drop_exact_duplicates(good).select(
        "trajectory_id", clock(), "latitude", "longitude", "altitude", "pos"
    )


@query("cln5_repeated_positions", q(RAW, f"SELECT {CLEAN_COLUMNS} FROM near WHERE repeat = 1"))
def repeated(spark, sf):
    once = cleaning.drop_exact_duplicates(
        cleaning.valid_fixes(adapter.raw_points(spark, sf))
    ).drop("copies")
    return cleaning.drop_repeated_positions(once).select(
        "trajectory_id", clock(), "latitude", "longitude", "altitude", "pos"
    )


@query(
    "cln6_source_inversions",
    q(
        RAW,
        """SELECT trajectory_id, count(*) AS n_points,
        count(*) FILTER (WHERE t_us < p) AS chronological_inversions
        FROM (SELECT *, lag(t_us) OVER (PARTITION BY trajectory_id ORDER BY pos) AS p FROM tidy)
        GROUP BY 1""",
    ),
)
def inversions(spark, sf):
    return cleaning.source_inversions(cleaning.clean(adapter.raw_points(spark, sf)))


@query(
    "cln7_same_second_order",
    q(RAW, "SELECT pos, trajectory_id, t_us, subsecond_seq, timestamp_collision FROM tidy"),
)
def same_second(spark, sf):
    return cleaning.clean(adapter.raw_points(spark, sf)).select(
        "pos", "trajectory_id", clock(), F.col("subsecond_seq").cast("bigint").alias("subsecond_seq"),
        "timestamp_collision",
    )


@query(
    "cln8_trip_intervals",
    q(
        RAW,
        """SELECT trajectory_id, count(*) AS clean_points, (max(t_us)-min(t_us))/1e6 AS duration_s,
        count(*) FILTER (WHERE d = 0) AS zero_dt_count, count(*) FILTER (WHERE d > 0) AS positive_dt_count
        FROM (SELECT *, t_us - lag(t_us) OVER (PARTITION BY trajectory_id
          ORDER BY t_us, subsecond_seq) AS d FROM tidy) GROUP BY 1""",
    ),
)
def intervals(spark, sf):
    return cleaning.trip_intervals(cleaning.clean(adapter.raw_points(spark, sf)))


@query(
    "cln9_removal_accounting",
    q(
        RAW,
        """SELECT reason, count(*) AS n FROM (
          SELECT reason FROM reasons WHERE reason IS NOT NULL
          UNION ALL SELECT 'exact_duplicate' FROM once WHERE copy > 1
          UNION ALL SELECT 'same_position_duplicate' FROM near WHERE repeat > 1
          UNION ALL SELECT 'kept' FROM tidy) GROUP BY 1""",
    ),
)
def accounting(spark, sf):
    return cleaning.removal_counts(adapter.raw_points(spark, sf))


STAT_SQL = """count({v}) AS count, round(min({v}),6) AS min, round(max({v}),6) AS max,
 round(avg({v}),6) AS mean, round({sd}({v}),6) AS std,
 round(quantile_cont({v},0.25),6) AS p25, round(quantile_cont({v},0.5),6) AS p50,
 round(quantile_cont({v},0.75),6) AS p75, round(quantile_cont({v},0.95),6) AS p95,
 round(quantile_cont({v},0.99),6) AS p99"""
STAT_COLUMNS = ("min", "max", "mean", "std", "p25", "p50", "p75", "p95", "p99")


def stats_sql(v: str, sd: str = "stddev_pop") -> str:
    return STAT_SQL.format(v=v, sd=sd)


@query(
    "cln10_interval_distribution",
    q(
        RAW,
        f"""SELECT {stats_sql('d')} FROM (SELECT (t_us - lag(t_us) OVER (PARTITION BY trajectory_id
          ORDER BY t_us, subsecond_seq))/1e6 AS d FROM tidy) WHERE d > 0""",
    ),
)
def interval_stats(spark, sf):
    d = cleaning.interval_distribution(cleaning.clean(adapter.raw_points(spark, sf)))
    return rounded(d, 6, STAT_COLUMNS)


@query("cln10_value_distribution_by_type",
       f"SELECT event_type, {stats_sql('value')} FROM events GROUP BY 1")
def value_stats(spark, sf):
    return rounded(distribution(adapter.table(spark, sf, "events"), ["event_type"], "value"), 6, STAT_COLUMNS)


@query(
    "cln11_first_users",
    q(pts(), """SELECT user_id, count(*) AS n FROM pts WHERE user_id IN
      (SELECT DISTINCT user_id FROM pts ORDER BY 1 LIMIT 20) GROUP BY 1"""),
)
def first_users(spark, sf):
    chosen = cleaning.first_users(adapter.points(spark, sf), 20)
    return chosen.groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "cln12_consent_gate",
    q(READINGS, """SELECT event_id, user_id FROM pts WHERE user_id IN (SELECT user_id FROM consent
      WHERE guardian_granted AND (NOT end_user_consent_applicable OR coalesce(end_user_granted, false)))"""),
)
def consent_gate(spark, sf):
    return cleaning.consented(
        adapter.points(spark, sf), adapter.consent(spark, sf)
    ).select("event_id", "user_id")


@query(
    "cln12_consent_rejects",
    q(READINGS, """SELECT user_id, count(*) AS n FROM pts WHERE user_id NOT IN (SELECT user_id FROM consent
      WHERE guardian_granted AND (NOT end_user_consent_applicable OR coalesce(end_user_granted, false))) GROUP BY 1"""),
)
def consent_rejects(spark, sf):
    out = cleaning.consented(adapter.points(spark, sf), adapter.consent(spark, sf), keep=False)
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "cln13_gps_quality",
    q(READINGS, """SELECT event_id, CASE WHEN is_degraded OR accuracy_m > 25 THEN 'INSUFFICIENT_GPS'
      ELSE 'GOOD' END AS gps_status FROM readings"""),
)
def gps_quality(spark, sf):
    return adapter.readings(spark, sf).select("event_id", cleaning.gps_quality().alias("gps_status"))


@query(
    "cln14_speed_and_heading",
    q(
        pts(),
        f"""SELECT event_id, speed_mps, round(coalesce(h, last_value(h IGNORE NULLS) OVER (
          PARTITION BY trajectory_id ORDER BY t_us, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS heading_deg
        FROM (SELECT *, CASE WHEN t_us > pt THEN least(round(step/((t_us-pt)/1e6), 2), 120.0) ELSE 0.0 END AS speed_mps,
          CASE WHEN step > 0.5 THEN {bearing('pla', 'plo', 'latitude', 'longitude')} END AS h
        FROM (SELECT *, {hav('pla', 'plo', 'latitude', 'longitude')} AS step FROM (
          SELECT *, lag(t_us) OVER w AS pt, lag(latitude) OVER w AS pla, lag(longitude) OVER w AS plo
          FROM pts WINDOW w AS (PARTITION BY trajectory_id ORDER BY t_us, event_id))))""",
    ),
)
def motion(spark, sf):
    m = cleaning.derive_motion(adapter.points(spark, sf))
    return m.select("event_id", "speed_mps", F.round("heading_deg", 6).alias("heading_deg"))


@query(
    "cln15_rebased_clock",
    q(pts(), """SELECT event_id, 1735689600000000 + t_us - min(t_us) OVER (PARTITION BY trajectory_id) AS t_us FROM pts"""),
)
def rebased(spark, sf):
    return cleaning.rebase_time(adapter.points(spark, sf), "2025-01-01 00:00:00").select(
        "event_id", clock()
    )


@query(
    "cln16_zone_validation",
    q(READINGS, """SELECT zone_id, CASE WHEN geometry_type = 'CIRCLE' AND radius_m <= 0
      THEN 'radius_not_positive' END AS problem FROM zones"""),
)
def zone_validation(spark, sf):
    return adapter.zones(spark, sf).select("zone_id", cleaning.zone_problem().alias("problem"))
