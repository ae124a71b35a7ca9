"""Read-side reports and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import geo
from tracewell.functions.quantiles import distribution, percentiles
from tracewell.session import store


def anchor_audit(anchors: DataFrame) -> DataFrame:
    """Anchors, radius and visits per status."""
    anchors = store(anchors.select("status", "radius_m", "observation_count"))
    mid = percentiles(anchors, ["status"], "radius_m", [0.5])
    totals = anchors.groupBy("status").agg(
        F.count("*").alias("anchors"),
        F.avg("radius_m").alias("mean_radius_m"),
        F.sum("observation_count").alias("visits"),
    )
    return totals.join(mid.select("status", F.col("q")[0].alias("median_radius_m")), "status")


def user_alerts(
    alerts: DataFrame, user_id: str, status: str | None = None, zone_id: str | None = None, limit: int = 50
) -> DataFrame:
    """Alerts of one user, newest first; the limit is part of the request (1 to 200)."""
    rows = alerts.where(F.col("user_id") == user_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if zone_id is not None:
        rows = rows.where(F.col("zone_id") == zone_id)
    return rows.orderBy(F.desc("t_us"), F.desc("event_id")).limit(max(1, min(limit, 200)))


def risk_history(
    history: DataFrame, user_id: str, start_us: int | None = None, end_us: int | None = None, limit: int = 500
) -> DataFrame:
    """Risk rows of one user in time order; without a start the newest ones."""
    rows = history.where(F.col("user_id") == user_id)
    if start_us is not None:
        rows = rows.where(F.col("t_us") >= start_us)
    if end_us is not None:
        rows = rows.where(F.col("t_us") <= end_us)
    n = max(1, min(limit, 2000))
    if start_us is None:
        rows = rows.orderBy(F.desc("t_us"), F.desc("event_id")).limit(n)
        return rows.orderBy("t_us", "event_id")
    return rows.orderBy("t_us", "event_id").limit(n)


STORED = (
    "location struct<lat: double, lng: double, altitude_m: double>, ml_evaluation map<string, string>"
)


def stored_parts(history: DataFrame, column: str = "raw_output_json") -> DataFrame:
    """Location and model evaluation from the stored JSON text; null where it cannot be read."""
    parsed = history.withColumn("_j", F.from_json(column, STORED))
    loc = F.col("_j.location")
    usable = loc["lat"].isNotNull() & loc["lng"].isNotNull()
    return parsed.withColumns({
        "location": F.when(usable, loc), "ml_evaluation": F.col("_j.ml_evaluation"),
    }).drop("_j")


def wearable_history(wearables: DataFrame, user_id: str, limit: int = 100) -> DataFrame:
    rows = wearables.where(F.col("user_id") == user_id)
    return rows.orderBy(F.desc("t_us"), F.desc("event_id")).limit(limit)


DISPLAY = {
    "WITH_COMPANION": "WITH_COMPANION", "SEPARATION_PENDING": "SEPARATION_PENDING",
    "SEPARATED": "SEPARATED", "REUNITE_PENDING": "REJOINING",
}


def accompaniment(
    sessions: DataFrame, now_us: int, threshold_m: float = 50.0, max_age_s: float = 60.0
) -> DataFrame:
    """Companion status of open sessions.

    Needs ``status, patient_lat, patient_lng, companion_lat, companion_lng, companion_us,
    patient_outside, companion_outside, machine_status`` (null without a separation machine).
    """
    fix = F.col("companion_lat").isNotNull() & F.col("companion_lng").isNotNull()
    age = (F.lit(now_us) - F.col("companion_us")) / 1e6
    stale = F.coalesce(age > max_age_s, F.lit(True))
    dist = geo.haversine("patient_lat", "patient_lng", "companion_lat", "companion_lng")
    usable = (F.col("status") == "ACTIVE") & fix & ~stale & F.col("patient_lat").isNotNull()
    mapped = F.lit(None).cast("string")
    for k, v in DISPLAY.items():
        mapped = F.when(F.col("machine_status") == k, v).otherwise(mapped)
    out = sessions.where(F.col("status").isin("ACTIVE", "PENDING_INVITE")).withColumns({
        "is_location_stale": stale, "separation_distance_m": F.when(usable, F.round(dist, 1)),
    })
    near = F.col("separation_distance_m") <= threshold_m
    plain = F.when(near, "WITH_COMPANION").otherwise("SEPARATED")
    status = F.when(~usable, "ACCOMPANIMENT_UNVERIFIED").otherwise(F.coalesce(mapped, plain))
    together = usable & near & F.col("patient_outside") & F.col("companion_outside")
    return out.withColumns({
        "accompaniment_status": status,
        "safe_zone_departure_accompanied": F.coalesce(together, F.lit(False)),
    })


def zone_list(zones: DataFrame, user_id: str) -> DataFrame:
    """Enabled zones of a user; deleting a zone only disables it."""
    return zones.where((F.col("user_id") == user_id) & F.col("is_enabled"))


def status_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("status").agg(F.count("*").alias("n"))


def retention(history: DataFrame, now_us: int, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Raw rows young enough to keep, and aggregates per cell and day of all rows."""
    fresh = history.where(F.col("t_us") >= now_us - days * 86_400_000_000)
    day = F.floor(F.col("t_us") / 86_400_000_000)
    rolled = history.groupBy("cell", day.alias("day")).agg(
        F.count("*").alias("readings"),
        F.avg("risk_score").alias("mean_score"),
        F.max("risk_score").alias("max_score"),
        F.countDistinct("user_id").alias("users"),
    )
    return fresh, rolled


def exploration(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trips and points per user, and the distributions of points and duration per trip."""
    trips = points.groupBy("user_id", "trajectory_id").agg(
        F.count("*").alias("points"),
        ((F.max(geo.micros("timestamp")) - F.min(geo.micros("timestamp"))) / 1e6).alias("duration_s"),
    )
    users = trips.groupBy("user_id").agg(
        F.count("*").alias("trips"), F.sum("points").alias("points")
    )
    long = trips.select(
        F.col("points").cast("double").alias("points"), "duration_s"
    ).unpivot([], ["points", "duration_s"], "metric", "v")
    return users, distribution(long, ["metric"], "v")
