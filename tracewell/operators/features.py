"""Window features: geometry, kinematics, turning and direction of every 120-second window.

One shuffle on the window key, one sort inside it for the filtered lags and the centroid, and one
aggregate.  Undefined values are null.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracewell.config import FeatureRules, SegmentRules
from tracewell.functions import geo
from tracewell.functions.quantiles import distribution
from tracewell.operators.segments import SEGMENT, segment_points, with_window_type

KEY = [*SEGMENT, "window_index"]

NUMERIC = (
    "point_count", "temporal_span_sec", "zero_dt_count", "zero_dt_fraction", "dt_mean",
    "dt_median", "dt_min", "dt_max", "dt_std", "path_distance_m",
    "straight_line_displacement_m", "step_distance_mean", "step_distance_median",
    "step_distance_max", "step_distance_min", "step_distance_std", "tortuosity_index",
    "path_closure_ratio", "radius_of_gyration", "bbox_height_m", "bbox_width_m",
    "bbox_diagonal_m", "bbox_area_sqm", "mean_speed_mps", "median_speed_mps", "max_speed_mps",
    "min_speed_mps", "speed_std_dev", "speed_variance", "extreme_transition_count",
    "extreme_transition_fraction", "mean_acceleration_mps2", "max_acceleration_mps2",
    "min_acceleration_mps2", "acceleration_std_dev", "heading_change_mean",
    "heading_change_std", "turn_frequency", "backtracking_tendency", "pacing_tendency",
    "loop_metric", "heading_variability", "spatial_randomness_dispersion",
    "entropy_directional",
)
FLAGS = (
    "is_full_window", "has_displacement", "has_valid_kinematics", "has_acceleration",
    "has_valid_turns", "has_entropy", "is_kinematically_evaluable",
    "has_extreme_kinematic_transition",
)
CORRELATED = (
    "point_count", "path_distance_m", "straight_line_displacement_m", "tortuosity_index",
    "path_closure_ratio", "loop_metric", "pacing_tendency", "radius_of_gyration",
    "mean_speed_mps", "turn_frequency", "heading_variability", "entropy_directional",
)
EXTENDED = (
    "mean_acceleration_mps2", "max_acceleration_mps2", "acceleration_std_dev", "max_speed_mps",
    "min_speed_mps", "median_speed_mps", "speed_variance", "heading_change_mean",
    "heading_change_std", "path_closure_ratio", "radius_of_gyration", "bbox_diagonal_m",
    "bbox_area_sqm", "spatial_randomness_dispersion", "step_distance_mean",
    "step_distance_max", "step_distance_std", "zero_dt_count", "zero_dt_fraction",
)


def _steps(segmented: DataFrame, rules: FeatureRules, window_s: int) -> DataFrame:
    """Per point: the step from the previous point of the same window, null on its first point."""
    w_us = window_s * 1_000_000
    prev_window = F.floor((F.col("prev_us") - F.col("segment_start_us")) / w_us)
    first = (
        F.col("prev_us").isNull()
        | (F.col("prev_us") < F.col("segment_start_us"))
        | (prev_window < F.col("window_index"))
    )
    step = F.when(~first, geo.haversine("prev_lat", "prev_lon", "latitude", "longitude"))
    moved = (
        segmented.select(
            *KEY, "t_us", "subsecond_seq", "segment_start_us", "latitude", "longitude",
            "prev_lat", "prev_lon", F.when(~first, F.col("dt")).alias("dt"), step.alias("step"),
        )
        .withColumns({
            "speed": F.when(F.col("dt") > 0, F.col("step") / F.col("dt")),
            "speed_dt": F.when(F.col("dt") > 0, F.col("dt")),
            "bearing": F.when(
                F.col("step") >= rules.min_bearing_step_m,
                geo.bearing("prev_lat", "prev_lon", "latitude", "longitude"),
            ),
        })
    )
    x, y, z = geo.unit_vector("latitude", "longitude")
    moved = moved.withColumns({
            "_x": x,
            "_y": y,
            "_z": z,
        })
    w = Window.partitionBy(*KEY).orderBy("t_us", "subsecond_seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return moved.select(
        "*",
        F.last("speed", ignorenulls=True).over(before).alias("_ps"),
        F.last("speed_dt", ignorenulls=True).over(before).alias("_pd"),
        F.last("bearing", ignorenulls=True).over(before).alias("_pb"),
        F.avg("_x").over(whole).alias("_cx"),
        F.avg("_y").over(whole).alias("_cy"),
        F.avg("_z").over(whole).alias("_cz"),
        F.min("longitude").over(whole).alias("_lon0"),
        F.max("longitude").over(whole).alias("_lon1"),
    )


def _median(value: str) -> Column:
    """Median of the values of a window.

    Spark's ``percentile`` compiles a projection for every group that it writes or reads, which costs far more than the few values.
    """
    values = F.sort_array(F.collect_list(value))
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)


def window_features(
    segmented: DataFrame,
    rules: FeatureRules = FeatureRules(),
    segment_rules: SegmentRules = SegmentRules(),
) -> DataFrame:
    """The feature table: one row per retained window of a segmented point table."""
    p = _steps(segmented, rules, segment_rules.window_s)
    clat, clon = geo.centroid_lat("_cx", "_cy", "_cz"), geo.centroid_lon("_cx", "_cy")
    p = p.withColumns({
            "_clat": clat,
            "_clon": clon,
        })
    to_centre = geo.haversine("latitude", "longitude", "_clat", "_clon")
    accel = (F.col("speed") - F.col("_ps")) / (0.5 * (F.col("speed_dt") + F.col("_pd")))
    turn = F.abs(geo.signed_turn("bearing", "_pb"))
    p = (
        p.withColumns({
            "_d2": to_centre * to_centre,
            "_acc": accel,
            "_turn": turn,
            "_oct": F.floor(F.col("bearing") / (360.0 / rules.octants)) % rules.octants,
            "_wide": F.when(F.col("_lon1") - F.col("_lon0") >= 180, F.col("longitude")),
        })
    )
    at = F.struct("t_us", "subsecond_seq")
    here = F.struct("latitude", "longitude")
    rad = F.radians("bearing")
    g = p.groupBy(*KEY).agg(
        F.min("segment_start_us").alias("segment_start_us"),
        F.min("t_us").alias("first_us"),
        F.max("t_us").alias("last_us"),
        F.count("*").alias("point_count"),
        F.count("dt").alias("_steps"),
        F.count_if(F.col("dt") == 0).alias("zero_dt_count"),
        F.avg("dt").alias("dt_mean"),
        _median("dt").alias("dt_median"),
        F.min("dt").alias("dt_min"),
        F.max("dt").alias("dt_max"),
        F.stddev_samp("dt").alias("dt_std"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_distance_m"),
        F.avg("step").alias("step_distance_mean"),
        _median("step").alias("step_distance_median"),
        F.max("step").alias("step_distance_max"),
        F.min("step").alias("step_distance_min"),
        F.stddev_samp("step").alias("step_distance_std"),
        F.min_by(here, at).alias("_a"),
        F.max_by(here, at).alias("_b"),
        F.sqrt(F.avg("_d2")).alias("_rg"),
        F.min("latitude").alias("_lat0"),
        F.max("latitude").alias("_lat1"),
        F.min("_lon0").alias("_lon0"),
        F.max("_lon1").alias("_lon1"),
        F.collect_set("_wide").alias("_lons"),
        F.min("_clat").alias("centroid_lat"),
        F.min("_clon").alias("centroid_lon"),
        F.count("speed").alias("_speeds"),
        F.avg("speed").alias("mean_speed_mps"),
        _median("speed").alias("median_speed_mps"),
        F.max("speed").alias("max_speed_mps"),
        F.min("speed").alias("min_speed_mps"),
        F.stddev_samp("speed").alias("speed_std_dev"),
        F.var_samp("speed").alias("speed_variance"),
        F.count_if(F.col("speed") > rules.extreme_speed_mps).alias("extreme_transition_count"),
        F.avg("_acc").alias("mean_acceleration_mps2"),
        F.max("_acc").alias("max_acceleration_mps2"),
        F.min("_acc").alias("min_acceleration_mps2"),
        F.stddev_samp("_acc").alias("acceleration_std_dev"),
        F.count("bearing").alias("_bearings"),
        F.avg(F.cos(rad)).alias("_cosb"),
        F.avg(F.sin(rad)).alias("_sinb"),
        F.count("_turn").alias("_turns"),
        F.avg("_turn").alias("heading_change_mean"),
        F.stddev_samp("_turn").alias("heading_change_std"),
        F.count_if(F.col("_turn") >= rules.turn_deg).alias("_sharp"),
        F.count_if(F.col("_turn") >= rules.reversal_deg).alias("_reversals"),
        *[F.count_if(F.col("_oct") == i).alias(f"_o{i}") for i in range(rules.octants)],
    )
    return _finish(with_window_type(g, segment_rules).where("is_retained"), rules)


@F.pandas_udf(DoubleType())
def _entropy_bits(*shares: pd.Series) -> pd.Series:
    """Entropy of shares, added in their order, with the C library's log2.

    Spark's ``log2`` divides two logarithms and can be a hair off, so that values that tie with a percentile fall on its other side.
    """
    return sum(pd.Series([-p * math.log2(p) if p > 0 else 0.0 for p in s], dtype="float64") for s in shares)


def _finish(g: DataFrame, rules: FeatureRules) -> DataFrame:
    n, path = F.col("point_count"), F.col("path_distance_m")
    several = n > 1
    span = (F.col("last_us") - F.col("first_us")) / 1e6
    lon_span = F.when(F.size("_lons") > 0, geo.circular_span(F.col("_lons"))).otherwise(
        F.col("_lon1") - F.col("_lon0")
    )
    share = [F.when(F.col("_bearings") > 0, F.col(f"_o{i}") / F.col("_bearings")) for i in range(rules.octants)]
    entropy = _entropy_bits(*share)
    g = (
        g.withColumns({
            "temporal_span_sec": span,
            "start_us": F.col("first_us"),
            "end_us": F.col("last_us"),
            "start_time": geo.from_micros("first_us"),
            "end_time": geo.from_micros("last_us"),
            "end_latitude": F.col("_b.latitude"),
            "end_longitude": F.col("_b.longitude"),
            "zero_dt_fraction": F.when(F.col("_steps") > 0, F.col("zero_dt_count") / F.col("_steps")).otherwise(0.0),
            "straight_line_displacement_m": geo.haversine("_a.latitude", "_a.longitude", "_b.latitude", "_b.longitude"),
        })
    )
    disp = F.col("straight_line_displacement_m")
    g = (
        g.withColumns({
            "tortuosity_index": F.when(several & (disp >= rules.min_tortuosity_disp_m), path / disp),
            "path_closure_ratio": F.when(
                (n >= rules.min_closure_points) & (path >= rules.min_closure_path_m),
                geo.unit_interval(1 - disp / path),
            ),
            "radius_of_gyration": F.when(several & (F.col("_rg") >= 1e-6), F.col("_rg")).otherwise(0.0),
            "bbox_height_m": geo.haversine("_lat0", "centroid_lon", "_lat1", "centroid_lon"),
            "bbox_width_m": geo.haversine("centroid_lat", F.lit(0.0), "centroid_lat", lon_span),
        })
    )
    h, w = F.col("bbox_height_m"), F.col("bbox_width_m")
    turning = F.col("_bearings") >= rules.min_turn_vectors
    closure = F.col("path_closure_ratio")
    g = (
        g.withColumns({
            "bbox_diagonal_m": F.sqrt(h * h + w * w),
            "bbox_area_sqm": h * w,
            "has_extreme_kinematic_transition": F.col("extreme_transition_count") > 0,
            "extreme_transition_fraction": F.when(F.col("_speeds") > 0, F.col("extreme_transition_count") / F.col("_speeds")).otherwise(0.0),
            "turn_frequency": F.when(turning, F.col("_sharp") / F.greatest(span / 60.0, F.lit(1 / 60.0))),
            "backtracking_tendency": F.when(turning, F.col("_reversals") / F.col("_turns")),
        })
    )
    back, diag = F.col("backtracking_tendency"), F.col("bbox_diagonal_m")
    g = (
        g.withColumns({
            "pacing_tendency": back * closure,
            "loop_metric": F.when(
                turning & (diag >= rules.min_diagonal_m),
                closure
                * (F.least(w, h) / F.greatest(w, h, F.lit(rules.min_diagonal_m)))
                * (1 - back),
            ),
            "heading_variability": F.when(
                turning,
                geo.unit_interval(
                    1 - F.sqrt(F.col("_cosb") * F.col("_cosb") + F.col("_sinb") * F.col("_sinb"))
                ),
            ),
            "spatial_randomness_dispersion": F.when(
                (n >= rules.min_dispersion_points) & (diag >= rules.min_diagonal_m),
                F.col("radius_of_gyration") / diag,
            ),
            "entropy_directional": F.when(
                F.col("_bearings") >= rules.min_entropy_vectors, entropy / math.log2(rules.octants)
            ),
            "has_displacement": several & (path > 0),
            "has_valid_kinematics": F.col("mean_speed_mps").isNotNull(),
            "has_acceleration": F.col("mean_acceleration_mps2").isNotNull(),
            "has_valid_turns": F.col("heading_change_mean").isNotNull(),
        })
        .withColumns({
            "has_entropy": F.col("entropy_directional").isNotNull(),
            "is_kinematically_evaluable": (n >= rules.evaluable_points)
            & (span >= rules.evaluable_span_s)
            & (path >= rules.evaluable_path_m),
        })
    )
    return g.select(
        "window_id", "user_id", "trajectory_id", "segment_id", "segment_index", "window_index",
        "start_time", "end_time", "start_us", "end_us", "segment_start_us",
        "centroid_lat", "centroid_lon", "end_latitude", "end_longitude",
        *NUMERIC, *FLAGS,
    )


def features_from_points(
    points: DataFrame,
    rules: FeatureRules = FeatureRules(),
    segment_rules: SegmentRules = SegmentRules(),
) -> DataFrame:
    """Clean points to feature table."""
    slim = points.select(
        "user_id", "trajectory_id", "timestamp", "subsecond_seq", "latitude", "longitude"
    )
    return window_features(segment_points(slim, segment_rules), rules, segment_rules)


def melt(df: DataFrame, ids: list[str], columns) -> DataFrame:
    """Long form: one row per feature with ``feature`` and ``value`` (null kept)."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(ids, list(columns), "feature", "value")


def feature_report(features: DataFrame) -> DataFrame:
    """Per numeric feature: missing values and the distribution of the rest."""
    long = melt(features, ["window_id"], NUMERIC)
    gaps = long.groupBy("feature").agg(
        F.count("*").alias("n_windows"),
        F.count_if(F.col("value").isNull()).alias("missing_count"),
        F.count_if(F.abs("value") == float("inf")).alias("inf_count"),
    )
    return gaps.join(distribution(long, ["feature"], "value", sample_std=True), "feature", "left")


def flag_shares(features: DataFrame) -> DataFrame:
    long = features.select(*[F.col(c).cast("int").alias(c) for c in FLAGS]).unpivot(
        [], list(FLAGS), "flag", "v"
    )
    return long.groupBy("flag").agg(
        F.sum("v").alias("true_count"),
        (F.count("*") - F.sum("v")).alias("false_count"),
        (100.0 * F.sum("v") / F.count("*")).alias("true_pct"),
    )


def correlations(features: DataFrame, columns=CORRELATED) -> DataFrame:
    """Pearson correlation of every feature pair over the windows where both exist.

    All pair sums are taken in one pass; the table is turned long afterwards.
    """
    wide = features.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.explode(rows).alias("x")).select(
        F.col("x.a").alias("feature_a"), F.col("x.b").alias("feature_b"), F.col("x.r").alias("r")
    )


def calendar(us: Column | str = "start_us") -> dict[str, Column]:
    """Hour, weekday (Monday 0) and their circular encodings of a microsecond clock."""
    us = F.col(us) if isinstance(us, str) else us
    hour = F.pmod(F.floor(us / 3_600_000_000), F.lit(24)).cast("double")
    day = F.pmod(F.floor(us / 86_400_000_000) + 3, F.lit(7)).cast("double")
    two_pi = 6.283185307179586
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "is_weekend": F.when(day >= 5, 1.0).otherwise(0.0),
        "sin_hour": F.sin(two_pi * hour / 24),
        "cos_hour": F.cos(two_pi * hour / 24),
        "sin_dow": F.sin(two_pi * day / 7),
        "cos_dow": F.cos(two_pi * day / 7),
    }


def enrich(dataset: DataFrame, features: DataFrame) -> DataFrame:
    """Add the extended window features and the circular calendar to a prediction dataset."""
    extra = features.select("window_id", *EXTENDED)
    missing = [c for c in EXTENDED if c not in dataset.columns]
    joined = dataset.join(extra.select("window_id", *missing), "window_id", "left")
    cal = calendar()
    return joined.withColumns({c: cal[c] for c in ("sin_hour", "cos_hour", "sin_dow", "cos_dow")})
