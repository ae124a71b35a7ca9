"""Scoring of whole traces: baseline choice, model, movement class, context and decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import behavior, decision, models, profiles, risk, zones
from tracewell.session import store


def score_windows(
    features: DataFrame,
    zone_table: DataFrame,
    place_profiles: DataFrame,
    fitted: dict[int, models.Fitted],
    population: DataFrame,
) -> DataFrame:
    """Window features to decisions, long by horizon.

    A trip is compared with what was known before it began: the user's earlier trips from the eighth trip on, ``population`` (the
    stored prior of the training users) before that.  Later trips change nothing.
    """
    trips = risk.numbered_trips(features).select("user_id", "trajectory_id", "trip_no")
    windows = store(features.join(trips, ["user_id", "trajectory_id"]))
    key = ["user_id", "base_no"]
    users = windows.select("user_id", F.col("trip_no").alias("base_no")).distinct().withColumns(
        {"trip_count": F.col("base_no") - 1, "cold_start_status": F.lit(None).cast("string")}
    )
    chosen = profiles.chosen_baselines(users, risk.past_baselines(windows), population, keys=key)
    mode = chosen.groupBy(*key).agg(F.max("profile_mode").alias("profile_mode"))
    judged = (
        risk.window_outliers(windows.withColumn("base_no", F.col("trip_no")), chosen, key)
        .join(mode, key)
        .withColumns({
            "trip_index": F.col("trip_no"),
            "is_cold_start": (F.col("profile_mode") == "COLD_START").cast("int"),
        })
    )
    judged = store(judged.drop(*[c for c in judged.columns if c.startswith("b_")]))
    inputs = store(risk.prediction_features(judged, extended=True))
    at_end = judged.select(
        "window_id", "user_id", F.col("end_latitude").alias("latitude"), F.col("end_longitude").alias("longitude"),
    )
    context = zones.spatial_context(at_end, zone_table, place_profiles).drop("user_id", "latitude", "longitude")
    moves = behavior.classify(judged).select(
        "window_id", "behavior_class", F.round(behavior.class_confidence(), 3).alias("behavior_confidence"),
        decision.top_features().alias("top_features"), "profile_mode",
    )
    outs = []
    for horizon, model in fitted.items():
        scored = models.score(inputs, model, horizon)
        tiers = decision.model_tiers(F.col("calibrated_probability"), F.col("threshold"))
        outs.append(
            scored.withColumns(tiers).withColumns({
                "binary_alert": F.col("y_pred"),
                "is_looping": F.lit(False),
                "is_corroborating_risk": F.lit(False),
            })
        )
    long = outs[0]
    for more in outs[1:]:
        long = long.unionByName(more)
    return decision.decide(long.join(context, "window_id", "left").join(moves, "window_id"))
