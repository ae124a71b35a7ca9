"""Heart-rate evidence against a personal baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import HeartRules

ON_WRIST = "ON_WRIST"


def heart_baseline(wearables: DataFrame, rules: HeartRules = HeartRules()) -> DataFrame:
    """Mean and deviation of the last valid on-wrist readings per user.

    ``row_number() <= n`` is evaluated per map task before the shuffle, so a user with very many
    readings sends only the newest ones of each task.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("t_us"), F.desc("event_id"))
    bpm = F.col("heart_rate_bpm")
    worn = (
        wearables.where(F.upper("wear_state") == ON_WRIST)
        .withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= rules.last_readings)
        .where(bpm.between(rules.min_bpm, rules.max_bpm))
    )
    return (
        worn.groupBy("user_id")
        .agg(
            F.avg(bpm).alias("_mean"),
            F.greatest(F.stddev_pop(bpm), F.lit(rules.std_floor)).alias("_std"),
            F.count("*").alias("baseline_sample_count"),
        )
        .where(F.col("baseline_sample_count") >= rules.min_samples)
        .select(
            "user_id",
            F.round("_mean", 1).alias("baseline_mean_bpm"),
            F.round("_std", 2).alias("baseline_std_bpm"),
            "baseline_sample_count",
            F.col("_mean").alias("exact_mean_bpm"),
            F.col("_std").alias("exact_std_bpm"),
        )
    )


def heart_status(rules: HeartRules = HeartRules()) -> Column:
    """First reason a reading cannot be used, or VALID.

    Needs ``has_reading, wear_state, heart_rate_bpm, reading_us, now_us, baseline_sample_count``.
    """
    bpm, age = F.col("heart_rate_bpm"), F.col("reading_age_sec")
    return (
        F.when(~F.col("has_reading"), "MISSING_DATA")
        .when(F.upper(F.coalesce("wear_state", F.lit("UNKNOWN"))) != ON_WRIST, "OFF_WRIST")
        .when(bpm.isNull() | ~bpm.between(rules.min_bpm, rules.max_bpm), "INVALID_READING")
        .when(age > rules.freshness_s, "STALE_READING")
        .when(F.col("baseline_sample_count").isNull(), "INSUFFICIENT_BASELINE")
        .otherwise("VALID")
    )


def heart_evidence(readings: DataFrame, baseline: DataFrame, rules: HeartRules = HeartRules()) -> DataFrame:
    """Status, z-score and response pattern of every reading."""
    age = F.round(F.greatest((F.col("now_us") - F.col("reading_us")) / 1e6, F.lit(0.0)), 1)
    joined = readings.join(baseline, "user_id", "left").withColumn("reading_age_sec", age)
    z = F.round(
        (F.col("heart_rate_bpm") - F.col("baseline_mean_bpm")) / F.col("baseline_std_bpm"), 2
    )
    out = joined.withColumn("hr_status", heart_status(rules)).withColumn(
        "z_score", F.when(F.col("hr_status") == "VALID", z)
    )
    resting = F.greatest(F.col("speed_mps"), F.lit(0.0)) < rules.resting_speed_mps
    pattern = (
        F.when(F.col("hr_status") != "VALID", "UNAVAILABLE")
        .when(F.col("z_score") < rules.elevated_z, "WITHIN_NORMAL_BASELINE")
        .when(resting, "ELEVATED_UNUSUAL_RESTING")
        .otherwise("EXERTION_CONCORDANT")
    )
    return (
        out.withColumn("response_pattern", pattern)
        .withColumn("is_corroborating_risk", F.col("response_pattern") == "ELEVATED_UNUSUAL_RESTING")
        .drop("exact_mean_bpm", "exact_std_bpm")
    )


def group_arousal(rules: HeartRules = HeartRules.group()) -> Column:
    """Arousal test used for separations: z-score or plain tachycardia."""
    z = F.round((F.col("heart_rate_bpm") - F.col("exact_mean_bpm")) / F.col("exact_std_bpm"), 2)
    fast = F.col("heart_rate_bpm") >= rules.tachycardia_bpm
    return F.coalesce(z >= rules.elevated_z, F.lit(False)) | F.coalesce(fast, F.lit(False))


def latest_readings(wearables: DataFrame, now_us: Column, rules: HeartRules = HeartRules()) -> DataFrame:
    """Newest reading per user with its age and a stale flag; combined before the shuffle."""
    newest = wearables.groupBy("user_id").agg(
        F.max_by(F.struct("t_us", "heart_rate_bpm", "wear_state"), F.struct("t_us", "event_id")).alias("_r")
    )
    age = F.greatest((now_us - F.col("_r.t_us")) / 1e6, F.lit(0.0))
    return newest.select(
        "user_id", "_r.*", F.round(age, 1).alias("age_seconds"), (age > rules.freshness_s).alias("is_stale")
    )
