"""Trips: endpoints, return trips, statistics and the distance reached from a reference point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import ProfileRules
from tracewell.functions import geo
from tracewell.functions.quantiles import percentiles

TRIP = ["user_id", "trajectory_id"]


def trip_table(points: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """First and last fix of every trip and the summed in-window path (null without windows)."""
    at = F.struct("timestamp", "subsecond_seq")
    here = F.struct("timestamp", "latitude", "longitude")
    ends = points.groupBy(*TRIP).agg(
        F.min_by(here, at).alias("_a"), F.max_by(here, at).alias("_b")
    )
    trips = ends.select(
        *TRIP,
        F.col("_a.timestamp").alias("start_time"),
        F.col("_a.latitude").alias("start_lat"),
        F.col("_a.longitude").alias("start_lon"),
        F.col("_b.timestamp").alias("end_time"),
        F.col("_b.latitude").alias("end_lat"),
        F.col("_b.longitude").alias("end_lon"),
    )
    if features is None:
        return trips.withColumn("path_distance_m", F.lit(None).cast("double"))
    path = features.groupBy(*TRIP).agg(F.sum("path_distance_m").alias("path_distance_m"))
    return trips.join(path, TRIP, "left")


def full_paths(segmented: DataFrame) -> DataFrame:
    """Path over all consecutive fixes of a trip, including steps across window borders."""
    step = geo.haversine("prev_lat", "prev_lon", "latitude", "longitude")
    return segmented.groupBy(*TRIP).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("full_path_m"))


def endpoint_table(trips: DataFrame) -> DataFrame:
    """One row per trip end: starts and ends with their type."""

    def side(name: str) -> DataFrame:
        return trips.select(
            *TRIP,
            F.col(f"{name}_time").alias("timestamp"),
            F.col(f"{name}_lat").alias("latitude"),
            F.col(f"{name}_lon").alias("longitude"),
            F.lit(name).alias("endpoint_type"),
            "path_distance_m",
        )

    return side("start").unionByName(side("end"))


def return_trips(trips: DataFrame, rules: ProfileRules = ProfileRules()) -> DataFrame:
    disp = geo.haversine("start_lat", "start_lon", "end_lat", "end_lon")
    path = F.col("path_distance_m")
    return trips.withColumn("endpoint_disp_m", disp).where(
        (F.col("endpoint_disp_m") <= rules.return_closure_m)
        & (path >= rules.return_min_path_m)
        & (path >= rules.return_path_ratio * F.col("endpoint_disp_m"))
    )


def variation(n: Column, mean: Column, std: Column) -> Column:
    """Coefficient of variation, null for fewer than two values or a mean of about zero."""
    return F.when((n >= 2) & (mean > 1e-9), std / mean)


def delta_variation(current: Column, before: Column) -> Column:
    """Relative change of the coefficient of variation."""
    ratio = F.abs(current - before) / F.nullif(before, F.lit(0.0))
    at_zero = F.when(current == 0, 0.0).otherwise(F.lit(float("inf")))
    return F.when(
        current.isNotNull() & before.isNotNull(), F.when(before == 0, at_zero).otherwise(ratio)
    )


def trip_variation(trips: DataFrame) -> DataFrame:
    """Coefficient of variation of the trip distance per user."""
    d = F.col("path_distance_m")
    return trips.groupBy("user_id").agg(
        F.count(d).alias("n_trips"),
        variation(F.count(d), F.avg(d), F.stddev_samp(d)).alias("cv"),
    )


def trip_statistics(
    trips: DataFrame, features: DataFrame, rules: ProfileRules = ProfileRules()
) -> DataFrame:
    """Return-trip distance (mean, variation) and speed of usable windows (mean, deviation)."""
    d = F.col("path_distance_m")
    back = return_trips(trips, rules).groupBy("user_id").agg(
        F.count(d).alias("return_trips"),
        F.avg(d).alias("avg_return_trip_distance_m"),
        variation(F.count(d), F.avg(d), F.stddev_samp(d)).alias("cv_return_trip_distance"),
    )
    v = F.col("mean_speed_mps")
    speed = (
        features.where(
            v.isNotNull()
            & F.col("is_kinematically_evaluable")
            & ~F.col("has_extreme_kinematic_transition")
        )
        .groupBy("user_id")
        .agg(
            F.avg(v).alias("avg_step_speed_mps"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("speed_std_dev"),
        )
    )
    users = trips.groupBy("user_id").agg(F.count("*").alias("trip_count"))
    return users.join(back, "user_id", "left").join(speed, "user_id", "left")


def reference_points(trips: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Per user the most visited anchor, or the median trip start."""
    if anchors is None:
        lat = percentiles(trips, ["user_id"], "start_lat", [0.5])
        lon = percentiles(trips, ["user_id"], "start_lon", [0.5])
        return lat.select("user_id", F.col("q")[0].alias("ref_lat")).join(
            lon.select("user_id", F.col("q")[0].alias("ref_lon")), "user_id"
        )
    first = F.struct(-F.col("observation_count"), "anchor_rank")
    primary = anchors.groupBy("user_id").agg(
        F.min_by(F.struct("center_latitude", "center_longitude"), first).alias("_p")
    )
    middle = reference_points(trips.join(primary, "user_id", "left_anti"))
    named = primary.select(
        "user_id",
        F.col("_p.center_latitude").alias("ref_lat"),
        F.col("_p.center_longitude").alias("ref_lon"),
    )
    return named.unionByName(middle)


def max_radius(points: DataFrame, references: DataFrame) -> DataFrame:
    """Largest distance of any fix from the reference point; combined before the shuffle."""
    far = points.join(references, "user_id")
    return far.groupBy("user_id").agg(
        F.max(geo.haversine("ref_lat", "ref_lon", "latitude", "longitude")).alias(
            "max_historical_radius_m"
        )
    )
