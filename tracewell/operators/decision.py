"""Scores to tiers, contextual decision states, polling and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import ScoringRules

TIERS = ("QUIESCENT", "NORMAL_TRANSIT", "SUSPICIOUS", "CRITICAL")
PDR_SCORES = {"INDOOR_PACING": 15.0, "ZONE_TRANSITION": 50.0, "UNTRACKED_DISPLACEMENT": 75.0}


def polling_tier(tier: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier) - 1).cast("int")


def model_tiers(p: Column, threshold: Column, rules: ScoringRules = ScoringRules()) -> dict[str, Column]:
    """Score 0-100, tier and polling tier of a calibrated probability."""
    score = F.round(p * 100.0, 2)
    tier = (
        F.when(score < rules.quiescent_below, TIERS[0])
        .when(p < threshold, TIERS[1])
        .when(score < rules.critical_from, TIERS[2])
        .otherwise(TIERS[3])
    )
    return {"risk_score": score, "risk_tier": tier, "polling_tier": polling_tier(tier)}


def operational_tier(score: Column, rules: ScoringRules = ScoringRules()) -> Column:
    a, b, c = rules.operational_cuts
    return (
        F.when(score <= a, TIERS[0]).when(score <= b, TIERS[1]).when(score <= c, TIERS[2]).otherwise(TIERS[3])
    )


def operational_score(readings: DataFrame) -> DataFrame:
    """Score, tier and lead time of a reading.

    Needs ``speed_mps, is_degraded, pdr_tier`` (null when not tracked), ``model_score`` (0 to 100, from the caller's model; null
    without one, then speed alone counts) and ``cell_multiplier`` (null for a cell without dismissals).
    """
    tracked = F.lit(None).cast("double")
    for name, value in PDR_SCORES.items():
        tracked = F.when(F.col("pdr_tier") == name, value).otherwise(tracked)
    moving = F.coalesce("model_score", F.least(F.lit(60.0), F.greatest(F.col("speed_mps"), F.lit(0.0)) * 12.0))
    raw = F.when(
        F.col("is_degraded") | F.col("pdr_tier").isNotNull(), F.coalesce(tracked, F.lit(15.0))
    ).otherwise(F.least(moving, F.lit(100.0)))
    scaled = raw * F.coalesce("cell_multiplier", F.lit(1.0))
    out = readings.withColumn(
        "risk_score", F.round(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0)), 1)
    ).withColumn("risk_tier", operational_tier(F.col("risk_score")))
    return out.withColumns({
        "polling_tier": polling_tier(F.col("risk_tier")),
        "predicted_lead_time_sec": lead_time(F.col("risk_score"), F.col("risk_tier")),
    })


def lead_time(score: Column, tier: Column) -> Column:
    """Seconds to act, only from SUSPICIOUS on."""
    return F.when(
        tier.isin(*TIERS[2:]), F.round(F.greatest(F.lit(240.0), 900.0 - (score - 65.0) * 15.0), 1)
    )


def polling_instruction(
    tier: Column, battery: Column, rules: ScoringRules = ScoringRules()
) -> Column:
    """How the device should sample: struct of mode, burst and sleep."""
    mode = (
        F.when((tier == "CRITICAL") & (battery < rules.last_gasp_pct), "LAST_GASP")
        .when((tier == "SUSPICIOUS") & (battery < rules.battery_lock_pct), "PULSE")
        .otherwise("CONTINUOUS")
    )
    pulse = lambda v: F.when(mode == "PULSE", F.lit(v))
    return F.struct(
        mode.alias("mode"),
        pulse(rules.pulse_burst_s).alias("burst_seconds"),
        pulse(rules.pulse_burst_hz).alias("burst_hz"),
        pulse(rules.pulse_sleep_s).alias("sleep_seconds"),
    )


def decide(df: DataFrame) -> DataFrame:
    """Decision state, display text, severity and reason.

    Needs ``risk_tier, risk_score, safe_area_state, familiarity_state, is_looping,
    is_corroborating_risk`` and the distances and names of the spatial context.  Looping is tested
    before the tiers, the tiers before the place.
    """
    c = F.col
    loop = F.coalesce(c("is_looping"), F.lit(False))
    heart = F.coalesce(c("is_corroborating_risk"), F.lit(False))
    zone, place, tier = c("safe_area_state"), c("familiarity_state"), c("risk_tier")
    outside, inside = zone == "OUTSIDE_SAFE_AREA", zone == "INSIDE_SAFE_AREA"
    state = (
        F.when(loop & heart, "LOOPING_WITH_PHYSIOLOGICAL_AROUSAL")
        .when(loop, "PERSISTENT_LOOPING")
        .when(tier == "CRITICAL", "CRITICAL")
        .when(tier == "SUSPICIOUS", "SUSPICIOUS")
        .when(outside, "OUTSIDE_SAFE_AREA")
        .when(inside, "SAFE / NORMAL")
        .when(place == "FAMILIAR_LOCATION", "FAMILIAR_MOVEMENT")
        .when(place == "UNFAMILIAR_LOCATION", "UNFAMILIAR_MOVEMENT")
        .otherwise("SAFE / NORMAL")
    )
    d = c("decision_state")
    aroused = heart & ~loop
    display = (
        F.when(d == "LOOPING_WITH_PHYSIOLOGICAL_AROUSAL", "PERSISTENT LOOPING WITH PHYSIOLOGICAL AROUSAL")
        .when(d == "PERSISTENT_LOOPING", "PERSISTENT LOOPING DETECTED")
        .when((d == "CRITICAL") & aroused, "CRITICAL EXCURSION (PHYSIOLOGICAL AROUSAL)")
        .when(d == "CRITICAL", "CRITICAL KINEMATIC EXCURSION")
        .when((d == "SUSPICIOUS") & aroused, "SUSPICIOUS MOVEMENT (PHYSIOLOGICAL AROUSAL)")
        .when(d == "SUSPICIOUS", "SUSPICIOUS MOVEMENT PATTERN")
        .when((d == "OUTSIDE_SAFE_AREA") & aroused, "OUTSIDE SAFE AREA (PHYSIOLOGICAL AROUSAL)")
        .when(d == "OUTSIDE_SAFE_AREA", "OUTSIDE SAFE AREA (NORMAL KINEMATICS)")
        .when(d == "FAMILIAR_MOVEMENT", "FAMILIAR MOVEMENT")
        .when(d == "UNFAMILIAR_MOVEMENT", "UNFAMILIAR MOVEMENT (NORMAL KINEMATICS)")
        .otherwise("SAFE / NORMAL")
    )
    severity = (
        F.when(d.isin("LOOPING_WITH_PHYSIOLOGICAL_AROUSAL", "CRITICAL"), "ALERT")
        .when(d == "PERSISTENT_LOOPING", F.when(tier == "CRITICAL", "ALERT").otherwise("WARNING"))
        .when(d == "SUSPICIOUS", "WARNING")
        .when(d == "OUTSIDE_SAFE_AREA", F.when(aroused, "WARNING").otherwise("ADVISORY"))
        .when(d == "UNFAMILIAR_MOVEMENT", "ADVISORY")
        .otherwise("NORMAL")
    )
    where = (
        F.when(inside, F.concat_ws(" ", F.lit("inside zone"), "matched_safe_area_name"))
        .when(
            outside,
            F.concat(
                c("distance_to_safe_boundary_m").cast("string"), F.lit(" m outside zone "),
                F.coalesce("matched_safe_area_name", F.lit("?")),
            ),
        )
        .when(place == "FAMILIAR_LOCATION", F.concat(F.lit("near anchor "), F.coalesce("nearest_anchor_id", F.lit("?"))))
        .when(place == "UNFAMILIAR_LOCATION", F.lit("away from all anchors"))
        .otherwise("no place context")
    )
    reason = F.concat(
        F.lower(F.regexp_replace(d, "_", " ")), F.lit("; score "), F.format_number("risk_score", 1),
        F.lit("; "), where, F.when(heart, "; unusual resting heart rate").otherwise(""),
    )
    return df.withColumn("decision_state", state).withColumns(
        {"display_state": display, "severity_level": severity, "reason": reason}
    )


def trip_summary(scored: DataFrame) -> DataFrame:
    """Per trip and horizon: windows, alerts, peak score and the state of the last window."""
    last = F.struct("end_us", "window_id")
    return scored.groupBy("trajectory_id", "horizon_s").agg(
        F.count("*").alias("windows"),
        F.count_if("binary_alert").alias("alerts_fired"),
        F.max("risk_score").alias("peak_score"),
        F.max_by("risk_score", last).alias("current_score"),
        F.max_by("decision_state", last).alias("last_decision_state"),
    )


TOP_FEATURES = ("max_mad_z_score", "p95_exceedance_count", "mean_speed_mps", "tortuosity_index")


def top_features(extra: list[tuple[Column, str, float]] = []) -> Column:
    """Short list of contributing inputs that have a value; ``extra`` entries come first."""
    listed = F.filter(
        F.array(
            *[
                F.struct(F.lit(n).alias("feature"), F.round(F.col(n).cast("double"), 3).alias("value"))
                for n in TOP_FEATURES
            ]
        ),
        lambda s: s["value"].isNotNull(),
    )
    if not extra:
        return listed
    first = F.filter(
        F.array(
            *[
                F.struct(F.lit(n).alias("feature"), F.when(on, F.lit(v)).alias("value"))
                for on, n, v in extra
            ]
        ),
        lambda s: s["value"].isNotNull(),
    )
    return F.concat(first, listed)
