"""Validation, removal accounting, de-duplication and derived motion of raw fixes.

Raw fixes carry ``pos``, their position in the source, because several rules keep the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import CleaningRules
from tracewell.functions import geo
from tracewell.functions.quantiles import distribution
from tracewell.functions.scan import ordered_scan, previous, seen_before, time_chunk

REMOVED = (
    "unparseable_timestamp",
    "missing_coordinates",
    "invalid_coordinates",
    "unset_clock",
)
POSITIONS_PER_CHUNK = 65_536


def removal_reason(rules: CleaningRules = CleaningRules()) -> Column:
    """First rule a fix fails, or null.  Each rule only sees survivors of the rules before it."""
    lat, lon, ts = F.col("latitude"), F.col("longitude"), F.col("timestamp")
    clock = F.lit(rules.earliest).cast("timestamp_ntz")
    return (
        F.when(ts.isNull(), REMOVED[0])
        .when(lat.isNull() | lon.isNull(), REMOVED[1])
        .when(~lat.between(*rules.lat_bounds) | ~lon.between(*rules.lon_bounds), REMOVED[2])
        .when(ts < clock, REMOVED[3])
    )


def valid_fixes(points: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    return points.where(removal_reason(rules).isNull())


def drop_exact_duplicates(points: DataFrame) -> DataFrame:
    """Keep the first of fully equal fixes and count the ``copies``.

    A hash aggregate: copies are merged before the shuffle, however many there are.
    """
    keys = [c for c in points.columns if c != "pos"]
    return points.groupBy(*keys).agg(F.min("pos").alias("pos"), F.count("*").alias("copies"))


def drop_repeated_positions(points: DataFrame) -> DataFrame:
    """Keep the first fix of the same trip, second and coordinates; count the ``repeats``."""
    keys = ["trajectory_id", "timestamp", "latitude", "longitude"]
    rest = [c for c in points.columns if c not in keys]
    merged = points.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), "pos").alias("_first"), F.count("*").alias("repeats")
    )
    return merged.select(*keys, "_first.*", "repeats")


def number_within_second(points: DataFrame) -> DataFrame:
    """Order of same-second fixes (source order) and a flag where there is more than one."""
    second = Window.partitionBy("trajectory_id", "timestamp").orderBy("pos")
    shared = F.lag("pos").over(second).isNotNull() | F.lead("pos").over(second).isNotNull()
    return points.withColumn(
        "subsecond_seq", (F.row_number().over(second) - 1).cast("int")
    ).withColumn("timestamp_collision", shared)


def clean(points: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """All cleaning rules in order; the result is the clean point table."""
    once = drop_exact_duplicates(valid_fixes(points, rules)).drop("copies")
    return number_within_second(drop_repeated_positions(once).drop("repeats"))


def removal_counts(points: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Per reason: removed fixes, or kept ones under ``kept``; one row per reason that occurs."""
    tagged = points.withColumn("reason", removal_reason(rules))
    failed = tagged.where(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count("*").alias("n")
    )
    exact = drop_exact_duplicates(valid_fixes(points, rules))
    near = drop_repeated_positions(exact.drop("copies"))
    late = exact.agg(F.sum(F.col("copies") - 1).alias("a")).crossJoin(
        near.agg(F.sum(F.col("repeats") - 1).alias("b"), F.count("*").alias("c"))
    )  # one row each
    rows = late.select(
        F.explode(
            F.array(
                F.struct(F.lit("exact_duplicate").alias("reason"), F.col("a").alias("n")),
                F.struct(F.lit("same_position_duplicate").alias("reason"), F.col("b").alias("n")),
                F.struct(F.lit("kept").alias("reason"), F.col("c").alias("n")),
            )
        ).alias("x")
    ).select("x.reason", "x.n")
    return failed.unionByName(rows).where(F.col("n") > 0)


def source_inversions(points: DataFrame) -> DataFrame:
    """Per trip: fixes whose time is before that of the fix ahead of them in the source."""
    scanned = ordered_scan(
        points.select("trajectory_id", "pos", geo.micros("timestamp").alias("t_us")),
        ["trajectory_id"],
        ["pos"],
        F.floor(F.col("pos") / POSITIONS_PER_CHUNK).cast("bigint"),
        {"_prev": previous(F.col("t_us"))},
    )
    return scanned.groupBy("trajectory_id").agg(
        F.count("*").alias("n_points"),
        F.count_if(F.col("t_us") < F.col("_prev")).alias("chronological_inversions"),
    )


def with_interval(points: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """Add ``dt``: seconds since the previous clean fix of the trip (null on the first)."""
    timed = points.withColumn("_t", geo.micros("timestamp"))
    scanned = ordered_scan(
        timed,
        ["trajectory_id"],
        ["_t", "subsecond_seq"],
        time_chunk("_t", chunk_s),
        {"_prev": previous(F.col("_t"))},
    )
    return scanned.withColumn("dt", (F.col("_t") - F.col("_prev")) / 1e6).drop("_t", "_prev")


def trip_intervals(points: DataFrame) -> DataFrame:
    """Per trip: points, duration, zero intervals and positive intervals."""
    return (
        with_interval(points)
        .groupBy("trajectory_id")
        .agg(
            F.count("*").alias("clean_points"),
            (
                (geo.micros(F.max("timestamp")) - geo.micros(F.min("timestamp"))) / 1e6
            ).alias("duration_s"),
            F.count_if(F.col("dt") == 0).alias("zero_dt_count"),
            F.count_if(F.col("dt") > 0).alias("positive_dt_count"),
        )
    )


def interval_distribution(points: DataFrame) -> DataFrame:
    """Distribution of the positive sampling intervals over all trips."""
    return distribution(with_interval(points).where("dt > 0"), [], "dt")


def quality_report(points: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """The ingest report as one row."""
    tidy = clean(points, rules)
    kept = tidy.agg(
        F.count("*").alias("total_clean_points"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("trajectory_id").alias("trajectories"),
        F.count_if(F.col("subsecond_seq") > 0).alias("preserved_same_second"),
        F.min("latitude").alias("min_latitude"),
        F.max("latitude").alias("max_latitude"),
        F.min("longitude").alias("min_longitude"),
        F.max("longitude").alias("max_longitude"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
    )
    raw = points.agg(F.count("*").alias("total_raw_points"))
    trips = trip_intervals(tidy).agg(
        F.sum("zero_dt_count").alias("zero_dt_transitions"),
        F.max("duration_s").alias("longest_trip_s"),
    )
    # Three one-row frames side by side.
    return raw.crossJoin(kept).crossJoin(trips)


def first_users(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` users in id order (a feature of the ingest job)."""
    chosen = df.select("user_id").distinct().orderBy("user_id").limit(n)
    return df.join(chosen, "user_id", "left_semi")


def consented(df: DataFrame, consent: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of users whose guardian agreed and, where it applies, who agreed themselves."""
    agreed = consent.where(
        F.col("guardian_granted")
        & (~F.col("end_user_consent_applicable") | F.coalesce("end_user_granted", F.lit(False)))
    ).select("user_id")
    return df.join(agreed, "user_id", "left_semi" if keep else "left_anti")


def gps_quality(
    accuracy: str = "accuracy_m", degraded: str = "is_degraded", rules: CleaningRules = CleaningRules()
) -> Column:
    """GOOD, or INSUFFICIENT_GPS for a poor accuracy or a degraded signal."""
    poor = F.col(degraded) | (F.col(accuracy) > rules.max_accuracy_m)
    return F.when(poor, "INSUFFICIENT_GPS").otherwise("GOOD")


def derive_motion(
    points: DataFrame, rules: CleaningRules = CleaningRules(), chunk_s: int = 3600
) -> DataFrame:
    """Speed (two decimals, capped) and heading (held while the step is tiny) per fix."""
    timed = points.withColumn("_t", geo.micros("timestamp"))
    here = F.struct("_t", "latitude", "longitude")
    order = ["_t", "subsecond_seq"]
    stepped = ordered_scan(
        timed, ["trajectory_id"], order, time_chunk("_t", chunk_s), {"_p": previous(here)}
    )
    step = geo.haversine("_p.latitude", "_p.longitude", "latitude", "longitude")
    dt = (F.col("_t") - F.col("_p._t")) / 1e6
    stepped = stepped.withColumn("_step", step).withColumn(
        "speed_mps",
        F.when(
            dt > 0, F.least(F.round(F.col("_step") / dt, 2), F.lit(rules.max_speed_mps))
        ).otherwise(0.0),
    )
    heading = F.when(
        F.col("_step") > rules.min_heading_step_m,
        geo.bearing("_p.latitude", "_p.longitude", "latitude", "longitude"),
    )
    held = ordered_scan(
        stepped.withColumn("_h", heading),
        ["trajectory_id"],
        order,
        time_chunk("_t", chunk_s),
        {"_held": seen_before(F.col("_h"))},
    )
    return held.withColumn("heading_deg", F.coalesce("_h", "_held", F.lit(0.0))).drop(
        "_t", "_p", "_step", "_h", "_held"
    )


def rebase_time(points: DataFrame, origin: str) -> DataFrame:
    """Shift every trip so that it starts at ``origin``, keeping its intervals."""
    starts = points.groupBy("trajectory_id").agg(F.min("timestamp").alias("_start"))
    shift = geo.micros("timestamp") - geo.micros("_start")
    base = geo.micros(F.lit(origin).cast("timestamp_ntz"))
    return (
        points.join(starts, "trajectory_id")
        .withColumn("timestamp", geo.from_micros(base + shift))
        .drop("_start")
    )


def zone_problem() -> Column:
    """Why a zone definition is unusable, or null."""
    v = F.col("vertices")
    bad_vertex = F.exists(
        v, lambda p: ~p["lat"].between(-90, 90) | ~p["lng"].between(-180, 180)
    )
    return (
        F.when(~F.col("geometry_type").isin("CIRCLE", "POLYGON"), "unknown_geometry")
        .when(
            (F.col("geometry_type") == "CIRCLE")
            & (F.col("center_lat").isNull() | F.col("center_lng").isNull()),
            "missing_center",
        )
        .when(
            (F.col("geometry_type") == "CIRCLE")
            & (F.col("radius_m").isNull() | (F.col("radius_m") <= 0)),
            "radius_not_positive",
        )
        .when(
            (F.col("geometry_type") == "POLYGON") & (v.isNull() | (F.size(v) < 3)),
            "too_few_vertices",
        )
        .when((F.col("geometry_type") == "POLYGON") & bad_vertex, "vertex_out_of_range")
    )
