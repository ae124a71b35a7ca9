"""Telemetry events: JSON text to typed columns, with the reason a document is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schemas

SIGNAL_STATES = ("VALID", "DEGRADED_SIGNAL")
WEAR_STATES = ("ON_WRIST", "OFF_WRIST", "UNKNOWN")


def problem() -> Column:
    """First broken rule of a parsed event ``e``, or null."""
    e = lambda path: F.col(f"e.{path}")

    def outside(path: str, low: float, high: float | None) -> Column:
        c = e(path)
        bad = c < low if high is None else ~c.between(low, high)
        return c.isNull() | bad

    worn = F.col("e.wearable_metrics").isNotNull()
    degraded = e("signal_status.state") == "DEGRADED_SIGNAL"
    return (
        F.when(F.col("e").isNull() | e("user_id").isNull(), "malformed")
        .when(e("timestamp").isNull(), "timestamp")
        .when(outside("location.lat", -90, 90) | outside("location.lng", -180, 180), "location")
        .when(e("sensor_metrics.horizontal_accuracy_m").isNull(), "accuracy")
        .when(outside("sensor_metrics.speed_mps", 0, None), "speed")
        .when(outside("sensor_metrics.heading_deg", 0, 360), "heading")
        .when(outside("sensor_metrics.battery_pct", 0, 100), "battery")
        .when(~F.coalesce(e("signal_status.state").isin(*SIGNAL_STATES), F.lit(False)), "signal_state")
        .when(degraded & e("imu_metrics.net_displacement_m").isNull(), "imu_required")
        .when(worn & outside("wearable_metrics.heart_rate_bpm", 30, 250), "heart_rate")
        .when(
            worn & ~F.coalesce(e("wearable_metrics.wear_state").isin(*WEAR_STATES), F.lit(False)), "wear_state"
        )
    )


def parse(json: DataFrame, column: str = "value") -> DataFrame:
    """Add the parsed event ``e`` and ``rejected`` (null when valid).  Works on streams."""
    return json.withColumn("e", F.from_json(column, schemas.TELEMETRY)).withColumn("rejected", problem())


def readings(parsed: DataFrame) -> DataFrame:
    """Flat readings of the valid events."""
    return parsed.where("rejected IS NULL").select(
        F.col("e.user_id").alias("user_id"),
        F.col("e.timestamp").alias("event_time"),
        F.unix_micros("e.timestamp").alias("t_us"),
        F.col("e.location.lat").alias("latitude"),
        F.col("e.location.lng").alias("longitude"),
        F.col("e.sensor_metrics.horizontal_accuracy_m").alias("accuracy_m"),
        F.col("e.sensor_metrics.speed_mps").alias("speed_mps"),
        F.col("e.sensor_metrics.battery_pct").alias("battery_pct"),
        (F.col("e.signal_status.state") == "DEGRADED_SIGNAL").alias("is_degraded"),
        F.col("e.imu_metrics.net_displacement_m").alias("net_displacement_m"),
        F.col("e.wearable_metrics").alias("wearable"),
    )
