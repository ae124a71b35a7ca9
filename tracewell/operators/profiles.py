"""Baselines and longitudinal user profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import BASELINE_FEATURES, ProfileRules, RiskRules, SegmentRules
from tracewell.functions import geo
from tracewell.functions.quantiles import spread
from tracewell.functions.scan import last_seen, ordered_scan, running_sum, time_chunk
from tracewell.operators import anchors as anchor_ops
from tracewell.operators import trips as trip_ops
from tracewell.operators.features import melt, window_features
from tracewell.operators.segments import segment_points
from tracewell.operators.trips import delta_variation, variation
from tracewell.session import store

MONTH_S = 30 * 86_400


def feature_baselines(features: DataFrame, rules: ProfileRules = ProfileRules()) -> DataFrame:
    """Per user and baseline feature: distribution type, Gamma moments, quantiles and spread."""
    keys = ["user_id", "feature"]
    long = melt(features, ["user_id"], BASELINE_FEATURES)
    fit = spread(long, keys, "value")
    names = F.explode(F.array(*[F.lit(f) for f in BASELINE_FEATURES])).alias("feature")
    every = features.select("user_id").distinct().select("user_id", names)
    gamma = (
        (F.col("sample_size") < rules.gamma_below_samples)
        & (F.col("min") > 0)
        & (F.coalesce("variance", F.lit(0.0)) > 1e-9)
    )
    kind = (
        F.when(F.col("sample_size").isNull(), "undefined").when(gamma, "gamma").otherwise("empirical")
    )
    return every.join(fit, keys, "left").select(
        *keys,
        kind.alias("distribution_type"),
        F.coalesce("sample_size", F.lit(0)).cast("bigint").alias("sample_size"),
        F.when(gamma, F.col("mean") * F.col("mean") / F.col("variance")).alias("gamma_shape_k"),
        F.when(gamma, F.col("variance") / F.col("mean")).alias("gamma_scale_theta"),
        "median",
        "p95",
        "p99",
        "mad",
        "robust_scale",
    )


def empirical_baselines(
    features: DataFrame,
    keys: list[str] | tuple[str, ...] = ("user_id",),
    rules: RiskRules = RiskRules(),
    columns=BASELINE_FEATURES,
) -> DataFrame:
    """Median, MAD, scale and P95 per key and feature; null below the minimum sample size."""
    keys = list(keys)
    long = melt(features, keys, columns)
    return sampled(spread(long, [*keys, "feature"], "value"), keys, rules)


def sampled(fit: DataFrame, keys: list[str] | tuple[str, ...], rules: RiskRules = RiskRules()) -> DataFrame:
    """Baselines from the spread of every key and feature; null below the minimum sample size."""
    enough = F.col("sample_size") >= rules.min_baseline_samples
    return fit.select(
        *keys,
        "feature",
        "sample_size",
        *[F.when(enough, F.col(c)).alias(c) for c in ("median", "mad", "robust_scale", "p95")],
    )


def population_baseline(features: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """The same statistics over all users (eight rows)."""
    return empirical_baselines(features, (), rules)


def as_of(df: DataFrame, cutoffs: DataFrame, column: str = "end_time", strict: bool = False) -> DataFrame:
    """Rows of each user up to that user's ``as_of`` time; no later row can leak in."""
    t, limit = F.col(column), F.col("as_of")
    return df.join(cutoffs.select("user_id", "as_of"), "user_id").where(
        t < limit if strict else t <= limit
    )


def chosen_baselines(
    users: DataFrame, personal: DataFrame, population: DataFrame, rules: RiskRules = RiskRules(), keys=("user_id",)
) -> DataFrame:
    """Personal baseline from seven trips on, else the population's; says which was used.

    ``users`` has ``keys`` (a user, or a user as of some trip), ``trip_count`` and ``cold_start_status``.  The population side is
    eight rows.
    """
    stats = ("median", "mad", "robust_scale", "p95", "sample_size")
    pop = population.select("feature", *[F.col(c).alias(f"_pop_{c}") for c in stats])
    warm = F.coalesce(F.col("trip_count"), F.lit(0)) >= rules.warmup_trips
    base = users.crossJoin(F.broadcast(pop)).join(personal, [*keys, "feature"], "left")
    return base.select(
        *keys,
        "feature",
        *[F.when(warm, F.col(c)).otherwise(F.col(f"_pop_{c}")).alias(c) for c in stats],
        F.when(warm, "PERSONALIZED").otherwise("COLD_START").alias("profile_mode"),
        F.when(warm, F.coalesce("cold_start_status", F.lit("ML_DRIVEN")))
        .otherwise("COLD_START")
        .alias("cold_start_status"),
        F.when(warm, "PERSONALIZED").otherwise("POPULATION").alias("baseline_type"),
        F.when(warm, F.col("trip_count")).otherwise(0).alias("trip_count"),
    )


def stability_history(trips: DataFrame, rules: ProfileRules = ProfileRules()) -> DataFrame:
    """Trip by trip: expanding variation of the distance, its change, stable streak and status."""
    d = F.col("path_distance_m")
    rows = store(
        trips.where(d.isNotNull()).select(
            "user_id", "trajectory_id", geo.micros("start_time").alias("start_us"), "path_distance_m"
        )
    )
    order, chunk = ["start_us", "trajectory_id"], time_chunk("start_us", MONTH_S)
    # Squares are summed about the first trip, which is as past as can be and near the others, so that they do not cancel.
    first = rows.groupBy("user_id").agg(F.min_by("path_distance_m", F.struct(*order)).alias("_first"))
    off = d - F.col("_first")
    sums = ordered_scan(
        rows.join(first, "user_id"),
        ["user_id"],
        order,
        chunk,
        {
            "trip_index": running_sum(F.lit(1)),
            "_s1": running_sum(off),
            "_s2": running_sum(off * off),
        },
    )

    def cv(n: Column, s1: Column, s2: Column) -> Column:
        spread2 = F.greatest((s2 - s1 * s1 / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
        return variation(n, F.col("_first") + s1 / n, F.sqrt(spread2))

    n, s1, s2 = F.col("trip_index"), F.col("_s1"), F.col("_s2")
    before = F.when(n > 1, cv(n - 1, s1 - off, s2 - off * off))
    steps = sums.withColumns({"cv": cv(n, s1, s2), "_before": before}).withColumn(
        "delta_cv", delta_variation(F.col("cv"), F.col("_before"))
    )
    stable = F.coalesce(F.col("delta_cv") < rules.stable_delta_cv, F.lit(False))
    broken = ordered_scan(
        steps, ["user_id"], order, chunk, {"_break": last_seen(F.when(~stable, n))}
    )
    streaks = broken.withColumn(
        "consecutive_stable_trips", n - F.coalesce("_break", F.lit(0))
    )
    ready = (n >= rules.cold_start_trips) & (
        F.col("consecutive_stable_trips") >= rules.stable_trips
    )
    # Once reached the status is kept, so the first trip that reaches it decides.
    latched = streaks.where(ready).groupBy("user_id").agg(F.min("trip_index").alias("_from"))
    return streaks.join(latched, "user_id", "left").select(
        "user_id",
        "trip_index",
        "trajectory_id",
        "path_distance_m",
        "cv",
        "delta_cv",
        "consecutive_stable_trips",
        F.when(n >= F.col("_from"), "ML_DRIVEN").otherwise("RULE_BASED_FALLBACK").alias("status"),
    )


def cold_start_status(history: DataFrame) -> DataFrame:
    """Final status, streak and the last defined change per user."""
    n = F.col("trip_index")
    return history.groupBy("user_id").agg(
        F.max_by("status", n).alias("cold_start_status"),
        F.max_by("consecutive_stable_trips", n).alias("consecutive_stable_trips"),
        F.max_by("delta_cv", F.when(F.col("delta_cv").isNotNull(), n)).alias("delta_cv"),
        F.count("*").alias("trips_with_path"),
    )


def quarantine(features: DataFrame, rules: ProfileRules = ProfileRules()) -> DataFrame:
    """Windows per user with implausible motion, by reason; nothing is removed."""
    v = F.col("mean_speed_mps")
    speed = spread(features, ["user_id"], "mean_speed_mps").select(
        "user_id", F.col("median").alias("_m"), F.col("robust_scale").alias("_s")
    )
    limit = F.when(
        F.col("_s") > 0,
        F.greatest(
            F.col("_m") + rules.quarantine_mad_multiplier * F.col("_s"),
            F.lit(rules.quarantine_floor_mps),
        ),
    )
    extreme = F.coalesce("has_extreme_kinematic_transition", F.lit(False))
    burst = F.coalesce(v > rules.quarantine_speed_mps, F.lit(False))
    outlier = F.coalesce(v > limit, F.lit(False))
    total = F.count("*")
    return (
        features.select("user_id", "mean_speed_mps", "has_extreme_kinematic_transition")
        .join(speed, "user_id", "left")
        .groupBy("user_id")
        .agg(
            total.alias("total_observations"),
            F.count_if(extreme | burst | outlier).alias("quarantined_observations"),
            F.count_if(extreme).alias("extreme_kinematic_transition"),
            F.count_if(burst).alias("unphysical_speed_burst"),
            F.count_if(outlier).alias("personal_mad_speed_outlier"),
            F.round(100.0 * F.count_if(extreme | burst | outlier) / total, 4).alias(
                "quarantine_percentage"
            ),
        )
    )


def user_profiles(
    points: DataFrame, features: DataFrame, rules: ProfileRules = ProfileRules()
) -> DataFrame:
    """One row per user with nested anchors, statistics, baselines and quarantine totals."""
    features = store(features)
    trips = store(trip_ops.trip_table(points, features))
    anchors = store(
        anchor_ops.anchor_table(
            anchor_ops.cluster_endpoints(trip_ops.endpoint_table(trips), rules), rules
        )
    )
    # One entry per anchor and per feature of a user: small lists by construction.
    places = anchors.groupBy("user_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "anchor_rank", "anchor_id", "center_latitude", "center_longitude", "radius_m",
                    "observation_count", "raw_endpoint_count", "status", "first_seen",
                    "last_seen", "typical_hours",
                )
            )
        ).alias("anchor_clusters")
    )
    base = feature_baselines(features, rules)
    fits = base.groupBy("user_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("feature", F.struct(*[c for c in base.columns if c not in ("user_id", "feature")]))
            )
        ).alias("baseline_distribution")
    )
    stats = trip_ops.trip_statistics(trips, features, rules).join(
        trip_ops.max_radius(points, trip_ops.reference_points(trips, anchors)), "user_id", "left"
    )
    status = cold_start_status(stability_history(trips, rules))
    held = quarantine(features, rules)
    nested = lambda df, name: df.select(
        "user_id", F.struct(*[c for c in df.columns if c != "user_id"]).alias(name)
    )
    return (
        nested(stats, "trip_stats")
        .join(status, "user_id", "left")
        .join(places, "user_id", "left")
        .join(fits, "user_id", "left")
        .join(nested(held, "quarantine_stats"), "user_id", "left")
        .withColumn("trip_count", F.col("trip_stats.trip_count"))
        .withColumn("cold_start_status", F.coalesce("cold_start_status", F.lit("RULE_BASED_FALLBACK")))
    )


def profile_json(profiles: DataFrame) -> DataFrame:
    """The interchange view: nested parts as JSON text."""
    parts = ("anchor_clusters", "trip_stats", "baseline_distribution", "quarantine_stats")
    return profiles.select(
        "user_id", "cold_start_status", "trip_count", "delta_cv", "consecutive_stable_trips",
        *[F.to_json(c).alias(c) for c in parts],
    )


def history_profiles(
    points: DataFrame, current: DataFrame, rules: RiskRules = RiskRules()
) -> tuple[DataFrame, DataFrame]:
    """Baseline of each user from the trips before its current one.

    ``current`` has one row per user: ``user_id, trajectory_id, as_of``.  Windows are anchored at
    the trip start (no gap split) and need three points.  Returns (summary, baselines).
    """
    past = as_of(
        points.join(current.select("trajectory_id"), "trajectory_id", "left_anti"),
        current,
        "timestamp",
        strict=True,
    )
    whole = SegmentRules(max_gap_s=float(10**9), min_window_points=3)
    slim = past.select(
        "user_id", "trajectory_id", "timestamp", "subsecond_seq", "latitude", "longitude"
    )
    windows = store(window_features(segment_points(slim, whole), segment_rules=whole))
    trips = windows.groupBy("user_id").agg(
        F.countDistinct("trajectory_id").alias("trip_count"), F.count("*").alias("windows")
    )
    summary = trips.withColumn(
        "profile_mode",
        F.when(F.col("trip_count") >= rules.warmup_trips, "PERSONALIZED").otherwise("COLD_START"),
    )
    return summary, empirical_baselines(windows, ("user_id",), rules)
