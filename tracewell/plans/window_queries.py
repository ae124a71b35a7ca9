"""Queries over segments, windows, window features and movement patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import geo
from tracewell.operators import behavior, features, segments
from tracewell.plans import adapter
from tracewell.plans.ingest_queries import STAT_COLUMNS, stats_sql
from tracewell.plans.registry import query, rnd, rounded
from tracewell.plans.sqltext import beh, bearing, feat, hav, pts, q, seg, win


def feature_table(spark, sf, squeeze: int = 1000):
    return features.features_from_points(adapter.points(spark, sf, squeeze))


def segmented(spark, sf, squeeze: int = 250):
    return segments.segment_points(adapter.points(spark, sf, squeeze))


@query("seg1_interval_to_previous", q(seg(250), "SELECT event_id, trajectory_id, t_us, dt FROM seg"))
def interval(spark, sf):
    return segmented(spark, sf).select("event_id", "trajectory_id", "t_us", "dt")


@query("seg2_gap_segments", q(seg(250), "SELECT event_id, segment_index, segment_id FROM seg"))
def gap_segments(spark, sf):
    return segmented(spark, sf).select(
        "event_id", F.col("segment_index").cast("bigint").alias("segment_index"), "segment_id"
    )


@query(
    "seg3_segment_table",
    q(
        seg(250),
        """SELECT segment_id, min(t_us) AS start_us, max(t_us) AS end_us, (max(t_us)-min(t_us))/1e6 AS duration_s,
        count(*) AS point_count, count(*) FILTER (WHERE seg_rn > 1 AND dt > 0) AS positive_dt_count,
        count(*) FILTER (WHERE seg_rn > 1 AND dt = 0) AS zero_dt_count FROM seg GROUP BY 1""",
    ),
)
def segment_table(spark, sf):
    return segments.segment_table(segmented(spark, sf)).select(
        "segment_id", "start_us", "end_us", "duration_s", "point_count", "positive_dt_count",
        "zero_dt_count",
    )


@query(
    "seg4_anchored_windows",
    q(win(250), """SELECT event_id, window_id, is_full AS is_full_window, s.window_index
      FROM seg s JOIN win w USING (trajectory_id, segment_index, window_index)"""),
)
def anchored_windows(spark, sf):
    return segments.windowed_points(adapter.points(spark, sf, 250)).select(
        "event_id", "window_id", "is_full_window",
        F.col("window_index").cast("bigint").alias("window_index"),
    )


@query(
    "seg5_window_retention",
    q(
        win(250),
        """SELECT raw_window_id, point_count, span_s, kept AS is_retained,
        CASE WHEN NOT kept THEN 'DISCARDED' WHEN is_full THEN 'FULL' ELSE 'PARTIAL' END AS window_type
        FROM (SELECT window_id AS raw_window_id, point_count, (last_us-first_us)/1e6 AS span_s, is_full,
          point_count >= 2 AND (is_full OR (last_us-first_us)/1e6 >= 20) AS kept FROM win)""",
    ),
)
def retention(spark, sf):
    from tracewell.config import SegmentRules

    rules = SegmentRules(min_window_points=2, min_window_span_s=20.0)
    return segments.window_table(segmented(spark, sf), rules).select(
        "raw_window_id", "point_count", "span_s", "is_retained", "window_type"
    )


@query(
    "seg6_segmentation_totals",
    q(
        win(250),
        """SELECT (SELECT count(DISTINCT user_id) FROM seg) AS users,
        (SELECT count(DISTINCT trajectory_id) FROM seg) AS source_trajectories,
        (SELECT count(DISTINCT segment_id) FROM seg) AS continuous_segments,
        (SELECT count(*) FROM seg) AS total_points,
        (SELECT count(*) FROM seg WHERE seg_rn > 1 AND dt = 0) AS zero_dt_transitions,
        count(*) AS total_windows, count(*) FILTER (WHERE is_full) AS full_windows,
        count(*) FILTER (WHERE NOT is_full) AS partial_windows, 0 AS discarded_windows,
        CAST(sum(point_count) AS BIGINT) AS points_assigned FROM win""",
    ),
)
def totals(spark, sf):
    return segments.segmentation_report(adapter.points(spark, sf, 250))[0]


@query(
    "seg6_segmentation_distributions",
    q(
        win(250),
        f"""SELECT metric, {stats_sql('v')} FROM (
        SELECT 'segment_duration_s' AS metric, (max(t_us)-min(t_us))/1e6 AS v FROM seg GROUP BY segment_id
        UNION ALL SELECT 'segment_point_count', count(*) FROM seg GROUP BY segment_id
        UNION ALL SELECT 'window_point_count', point_count FROM win
        UNION ALL SELECT 'window_span_s', (last_us-first_us)/1e6 FROM win
        UNION ALL SELECT 'temporal_gap_s', dt FROM seg WHERE dt > 300) GROUP BY 1""",
    ),
)
def distributions(spark, sf):
    d = segments.segmentation_report(adapter.points(spark, sf, 250))[1]
    return rounded(d, 6, STAT_COLUMNS)


@query(
    "seg7_pause_or_jump_parts",
    q(
        pts(100),
        f"""SELECT event_id, CAST(sum(b) OVER (PARTITION BY trajectory_id ORDER BY t_us, event_id
          ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part_index FROM (
        SELECT *, CASE WHEN {hav('pla', 'plo', 'latitude', 'longitude')} > 5000 OR (t_us-pt)/1e6 > 900
          THEN 1 ELSE 0 END AS b FROM (
          SELECT *, lag(t_us) OVER w AS pt, lag(latitude) OVER w AS pla, lag(longitude) OVER w AS plo
          FROM pts WINDOW w AS (PARTITION BY trajectory_id ORDER BY t_us, event_id)))""",
    ),
)
def parts(spark, sf):
    return segments.jump_segments(adapter.points(spark, sf, 100)).select("event_id", "part_index")


@query(
    "geo1_haversine",
    q(pts(), f"SELECT event_id, round({hav('latitude', 'longitude', '39.9', '116.3')}, 4) AS metres FROM pts"),
)
def haversine(spark, sf):
    d = geo.haversine("latitude", "longitude", F.lit(39.9), F.lit(116.3))
    return adapter.points(spark, sf).select("event_id", F.round(d, 4).alias("metres"))


@query(
    "geo2_bearing",
    q(pts(), f"SELECT event_id, round({bearing('latitude', 'longitude', '40.05', '116.41')}, 6) AS deg FROM pts"),
)
def bearing_q(spark, sf):
    b = geo.bearing("latitude", "longitude", F.lit(40.05), F.lit(116.41))
    return adapter.points(spark, sf).select("event_id", F.round(b, 6).alias("deg"))


@query(
    "geo3_spherical_centroid",
    q(pts(), """SELECT user_id, round(degrees(atan2(z, sqrt(x*x+y*y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon
      FROM (SELECT user_id, avg(cos(radians(latitude))*cos(radians(longitude))) AS x,
        avg(cos(radians(latitude))*sin(radians(longitude))) AS y, avg(sin(radians(latitude))) AS z
        FROM pts GROUP BY 1)"""),
)
def centroid(spark, sf):
    x, y, z = geo.unit_vector("latitude", "longitude")
    g = adapter.points(spark, sf).groupBy("user_id").agg(
        F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z")
    )
    return g.select(
        "user_id",
        F.round(geo.centroid_lat("x", "y", "z"), 6).alias("lat"),
        F.round(geo.centroid_lon("x", "y"), 6).alias("lon"),
    )


@query(
    "geo4_circular_longitude_span",
    q(
        pts(),
        """, r AS (SELECT DISTINCT trajectory_id, round(fmod(longitude*13.0, 360.0)-180.0, 6) AS lon FROM pts),
        g AS (SELECT trajectory_id, lon, lead(lon) OVER (PARTITION BY trajectory_id ORDER BY lon) - lon AS gap FROM r)
        SELECT trajectory_id, CASE WHEN count(*) <= 1 THEN 0.0 ELSE
          round(360.0 - greatest(max(gap), 360.0 - (max(lon)-min(lon))), 5) END AS span_deg
        FROM g GROUP BY 1""".lstrip(", "),
    ).replace("FROM base)\nr AS", "FROM base),\nr AS"),
)
def circular_span(spark, sf):
    lon = F.round(F.expr("(longitude * 13.0D) % 360.0D - 180.0D"), 6)
    return rounded(geo.circular_spans(adapter.points(spark, sf), ["trajectory_id"], lon), 5, ["span_deg"])


HEX_SQL = """SELECT {cols}, 'h9_' || CAST(CASE WHEN dq > dr AND dq > ds THEN -rr-rs ELSE rq END AS BIGINT)
  || '_' || CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq-rs ELSE rr END AS BIGINT) AS cell
FROM (SELECT *, abs(rq-qq) AS dq, abs(rr-rx) AS dr, abs(rs-sx) AS ds FROM (
  SELECT *, floor(qq+0.5) AS rq, floor(rx+0.5) AS rr, floor(sx+0.5) AS rs FROM (
  SELECT *, -qq-rx AS sx FROM (
  SELECT *, (longitude*111194.92664455873e0*cos(radians(latitude))*0.5773502691896258e0
     - latitude*111194.92664455873e0/3.0)/201.0 AS qq,
    (latitude*111194.92664455873e0*2.0/3.0)/201.0 AS rx FROM {src}))))"""


def hex_sql(cols: str, src: str) -> str:
    return HEX_SQL.format(cols=cols, src=src)


@query("geo5_hex_cell", q(pts(), hex_sql("event_id", "pts")))
def hex_cell(spark, sf):
    return adapter.points(spark, sf).select(
        "event_id", geo.hex_cell("latitude", "longitude").alias("cell")
    )


def _feature_query(name: str, columns: list[str], digits: int = 6) -> None:
    plain = [c for c in columns if c.startswith(("has_", "is_")) or c.endswith("count")]
    real = [c for c in columns if c not in plain]
    items = ", ".join(["window_id", *plain] + ([rnd(real, digits)] if real else []))

    @query(name, q(feat(), f"SELECT {items} FROM feat"))
    def run(spark, sf):
        return rounded(feature_table(spark, sf).select("window_id", *plain, *real), digits, real)


_feature_query("ft1_sampling_quality", ["zero_dt_count", "zero_dt_fraction", "dt_mean", "dt_median", "dt_min", "dt_max", "dt_std"], 9)
_feature_query("ft2_step_distances", ["path_distance_m", "straight_line_displacement_m", "step_distance_mean", "step_distance_median", "step_distance_max", "step_distance_min", "step_distance_std"], 5)
_feature_query("ft3_tortuosity", ["tortuosity_index"], 5)
_feature_query("ft4_path_closure", ["path_closure_ratio"])
_feature_query("ft5_radius_of_gyration", ["radius_of_gyration"], 4)
_feature_query("ft6_bounding_box", ["bbox_height_m", "bbox_width_m", "bbox_diagonal_m", "bbox_area_sqm"], 3)
_feature_query("ft7_speed", ["mean_speed_mps", "median_speed_mps", "max_speed_mps", "min_speed_mps", "speed_std_dev", "speed_variance"], 5)
_feature_query("ft8_extreme_transitions", ["has_extreme_kinematic_transition", "extreme_transition_count", "extreme_transition_fraction"])
_feature_query("ft9_acceleration", ["mean_acceleration_mps2", "max_acceleration_mps2", "min_acceleration_mps2", "acceleration_std_dev"], 5)
_feature_query("ft10_heading_change", ["heading_change_mean", "heading_change_std"], 5)
_feature_query("ft11_turns_and_backtracking", ["turn_frequency", "backtracking_tendency"])
_feature_query("ft12_pacing_tendency", ["pacing_tendency"])
_feature_query("ft13_loop_metric", ["loop_metric"], 5)
_feature_query("ft14_heading_variability", ["heading_variability"])
_feature_query("ft15_spatial_dispersion", ["spatial_randomness_dispersion"], 5)
_feature_query("ft16_directional_entropy", ["entropy_directional"])
_feature_query("ft17_computability_flags", [c for c in features.FLAGS])
_feature_query("ft18_feature_table", [c for c in (*features.NUMERIC, *features.FLAGS)], 3)



def long_sql(columns) -> str:
    """A UNION of one select per feature (explicit, because UNPIVOT drops nulls)."""
    return " UNION ALL ".join(
        f"SELECT window_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM feat" for c in columns
    )


@query(
    "ft19_feature_report",
    q(
        feat(),
        f"""SELECT feature, count(*) AS n_windows, count(*) FILTER (WHERE v IS NULL) AS missing_count,
        0 AS inf_count, {stats_sql('v', 'stddev_samp').replace(',6)', ',3)')} FROM ({long_sql(features.NUMERIC)}) GROUP BY 1""",
    ),
)
def feature_report(spark, sf):
    return rounded(features.feature_report(feature_table(spark, sf)), 3, STAT_COLUMNS)


@query(
    "ft19_flag_shares",
    q(
        feat(),
        "SELECT flag, count(*) FILTER (WHERE v) AS true_count, count(*) FILTER (WHERE NOT v) AS false_count,"
        " round(100.0*count(*) FILTER (WHERE v)/count(*), 6) AS true_pct FROM ("
        + " UNION ALL ".join(f"SELECT '{f}' AS flag, {f} AS v FROM feat" for f in features.FLAGS)
        + ") GROUP BY 1",
    ),
)
def flag_shares(spark, sf):
    return rounded(features.flag_shares(feature_table(spark, sf)), 6, ["true_pct"])


@query(
    "ft20_feature_correlation",
    q(
        feat(),
        " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) AS r FROM feat"
            for i, a in enumerate(features.CORRELATED)
            for b in features.CORRELATED[i:]
        ),
    ),
)
def correlation(spark, sf):
    return rounded(features.correlations(feature_table(spark, sf)), 4, ["r"])


@query(
    "ft21_extended_dataset",
    q(
        feat(),
        f"""SELECT window_id, {rnd(features.EXTENDED, 3)},
        round(sin(2*pi()*h/24), 6) + 0.0 AS sin_hour, round(cos(2*pi()*h/24), 6) + 0.0 AS cos_hour,
        round(sin(2*pi()*d/7), 6) + 0.0 AS sin_dow, round(cos(2*pi()*d/7), 6) + 0.0 AS cos_dow
        FROM (SELECT *, start_us // 3600000000 % 24 AS h, (start_us // 86400000000 + 3) % 7 AS d FROM feat)""",
    ),
)
def extended(spark, sf):
    f = feature_table(spark, sf)
    d = features.enrich(f.select("window_id", "start_us"), f).drop("start_us")
    d = rounded(d, 3, features.EXTENDED)
    return rounded(d, 6, ["sin_hour", "cos_hour", "sin_dow", "cos_dow"])


def classified(spark, sf):
    return behavior.classify(feature_table(spark, sf))


@query("beh1_movement_class", q(beh(), "SELECT window_id, behavior_class FROM beh"))
def movement_class(spark, sf):
    return classified(spark, sf).select("window_id", "behavior_class")


CONF = ["normal_confidence", "pacing_confidence", "lapping_confidence", "random_drift_confidence"]


@query("beh2_confidences", q(beh(), f"SELECT window_id, {rnd(CONF, 4)} FROM beh"))
def confidences(spark, sf):
    return rounded(classified(spark, sf).select("window_id", *CONF), 4, CONF)


@query(
    "beh3_class_shares",
    q(beh(), """SELECT behavior_class, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (), 6) AS pct
      FROM beh GROUP BY 1"""),
)
def class_shares(spark, sf):
    return rounded(behavior.class_shares(classified(spark, sf)), 6, ["pct"])


@query(
    "beh4_class_metrics",
    q(
        beh(),
        """SELECT behavior_class, feature, count(v) AS n, round(avg(v), 4) AS mean,
        round(quantile_cont(v, 0.25), 4) AS p25, round(median(v), 4) AS median,
        round(quantile_cont(v, 0.75), 4) AS p75 FROM ("""
        + " UNION ALL ".join(
            f"SELECT behavior_class, '{m}' AS feature, {m} AS v FROM beh" for m in behavior.METRICS
        )
        + ") WHERE v IS NOT NULL GROUP BY 1, 2",
    ),
)
def class_metrics(spark, sf):
    return rounded(behavior.class_metrics(classified(spark, sf)), 4, ["mean", "p25", "median", "p75"])


# A stand-in for ground truth: the class a coarser rule would give.
TRUTH_SQL = """CASE WHEN point_count < 3 OR path_distance_m < 12 THEN 'INSUFFICIENT_EVIDENCE'
  WHEN pacing_tendency >= 0.3 THEN 'PACING' WHEN loop_metric >= 0.4 THEN 'LAPPING'
  WHEN entropy_directional >= 0.65 THEN 'RANDOM_DRIFT' ELSE 'NORMAL' END"""


def judged(spark, sf):
    return classified(spark, sf).withColumn("true_class", F.expr(TRUTH_SQL))


@query(
    "beh5_confusion_matrix",
    q(beh(), f"SELECT {TRUTH_SQL} AS true_class, behavior_class AS predicted_class, count(*) AS n FROM beh GROUP BY 1, 2"),
)
def confusion(spark, sf):
    return behavior.confusion(judged(spark, sf))


@query(
    "beh6_class_report",
    q(
        beh(),
        f""", m AS (SELECT {TRUTH_SQL} AS t, behavior_class AS p FROM beh),
        c AS (SELECT unnest(['NORMAL','PACING','LAPPING','RANDOM_DRIFT','INSUFFICIENT_EVIDENCE']) AS class),
        s AS (SELECT class, (SELECT count(*) FROM m WHERE t = class) AS support,
          (SELECT count(*) FROM m WHERE p = class) AS hits,
          (SELECT count(*) FROM m WHERE p = class AND t = class) AS tp FROM c),
        r AS (SELECT class, support, CASE WHEN hits > 0 THEN tp/hits::DOUBLE ELSE 0.0 END AS pr,
          CASE WHEN support > 0 THEN tp/support::DOUBLE ELSE 0.0 END AS re FROM s),
        o AS (SELECT *, CASE WHEN pr+re > 0 THEN 2*pr*re/(pr+re) ELSE 0.0 END AS f FROM r)
        SELECT class, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1 FROM o
        UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6) FROM o""",
    ).replace(")\n, m AS", "),\nm AS"),
)
def class_report(spark, sf):
    return rounded(
        behavior.class_report(behavior.confusion(judged(spark, sf))), 6, ["precision", "recall", "f1"]
    )


@query(
    "beh7_first_mismatches",
    q(
        beh(),
        f"""SELECT window_id, true_class, behavior_class, {rnd(behavior.METRICS[:4], 4)},
        round(entropy_directional, 4) + 0.0 AS entropy_directional
        FROM (SELECT *, {TRUTH_SQL} AS true_class FROM beh) WHERE true_class <> behavior_class
        ORDER BY window_id LIMIT 10""",
    ),
)
def mismatches(spark, sf):
    d = behavior.first_mismatches(judged(spark, sf))
    return rounded(d, 4, [*behavior.METRICS[:4], "entropy_directional"])


REGIME = "CASE (segment_start_us // 1000000) % 4 WHEN 0 THEN 'strongly_diffusive' WHEN 1 THEN 'weakly_persistent' WHEN 2 THEN 'high_turn' ELSE 'spatially_dispersed' END"
REGIME_COLUMNS = [
    "recall", "median_entropy_directional", "median_heading_variability", "median_turn_frequency",
    "median_straight_line_displacement_m", "median_path_distance_m",
]


@query(
    "beh8_regime_report",
    q(
        beh(),
        f"""SELECT regime, count(*) AS total_windows,
        count(*) FILTER (WHERE behavior_class = 'RANDOM_DRIFT') AS detected_random_drift,
        count(*) FILTER (WHERE behavior_class = 'NORMAL') AS classified_normal,
        round(count(*) FILTER (WHERE behavior_class = 'RANDOM_DRIFT')/count(*)::DOUBLE, 3) AS recall,
        round(median(entropy_directional), 3) AS median_entropy_directional,
        round(median(heading_variability), 3) AS median_heading_variability,
        round(median(turn_frequency), 3) AS median_turn_frequency,
        round(median(straight_line_displacement_m), 3) AS median_straight_line_displacement_m,
        round(median(path_distance_m), 3) AS median_path_distance_m
        FROM (SELECT *, {REGIME} AS regime FROM beh) GROUP BY 1""",
    ),
)
def regimes(spark, sf):
    c = classified(spark, sf)
    names = c.select("window_id", F.expr(REGIME.replace("//", "div")).alias("regime"))
    return rounded(behavior.regime_report(c.join(names, "window_id")), 3, REGIME_COLUMNS)
