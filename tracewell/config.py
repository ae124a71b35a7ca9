"""Thresholds that define the results.  Fixed values: changing one changes what is computed."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_RADIUS_M = 6_371_000.0
MAD_TO_SIGMA = 1.4826


@dataclass(frozen=True)
class CleaningRules:
    lat_bounds: tuple[float, float] = (-90.0, 90.0)
    lon_bounds: tuple[float, float] = (-180.0, 180.0)
    earliest: str = "2005-01-01 00:00:00"
    header_lines: int = 6
    missing_altitude_ft: float = -777.0
    max_accuracy_m: float = 25.0
    max_speed_mps: float = 120.0
    min_heading_step_m: float = 0.5


@dataclass(frozen=True)
class SegmentRules:
    max_gap_s: float = 300.0
    window_s: int = 120
    min_window_points: int = 1
    min_window_span_s: float = 0.0
    jump_gap_s: float = 900.0
    jump_distance_m: float = 5000.0


@dataclass(frozen=True)
class FeatureRules:
    min_bearing_step_m: float = 0.5
    min_tortuosity_disp_m: float = 1.0
    min_closure_path_m: float = 10.0
    min_closure_points: int = 3
    min_turn_vectors: int = 2
    min_dispersion_points: int = 3
    min_diagonal_m: float = 1.0
    extreme_speed_mps: float = 340.0
    turn_deg: float = 30.0
    reversal_deg: float = 135.0
    octants: int = 8
    min_entropy_vectors: int = 3
    evaluable_points: int = 3
    evaluable_span_s: float = 10.0
    evaluable_path_m: float = 1.0


@dataclass(frozen=True)
class BehaviorRules:
    min_path_m: float = 10.0
    min_extent_m: float = 10.0
    pacing_closure: float = 0.60
    pacing_expansion: float = 1.80
    pacing_backtracking: float = 0.01
    pacing_max_entropy: float = 0.70
    lapping_closure: float = 0.60
    lapping_aspect: float = 0.20
    lapping_loop: float = 0.45
    lapping_max_backtracking: float = 0.05
    lapping_max_turn: float = 60.0
    drift_entropy: float = 0.70
    drift_heading_variability: float = 0.50
    drift_turn_frequency: float = 5.0
    drift_turn: float = 45.0
    drift_max_loop: float = 1.0


BASELINE_FEATURES = (
    "entropy_directional",
    "mean_speed_mps",
    "tortuosity_index",
    "path_distance_m",
    "straight_line_displacement_m",
    "turn_frequency",
    "loop_metric",
    "pacing_tendency",
)


@dataclass(frozen=True)
class ProfileRules:
    anchor_eps_m: float = 150.0
    anchor_min_points: int = 3
    anchor_confirmed_visits: int = 5
    anchor_min_radius_m: float = 25.0
    anchor_radius_quantile: float = 0.95
    stationary_path_m: float = 200.0
    return_closure_m: float = 200.0
    return_min_path_m: float = 200.0
    return_path_ratio: float = 2.0
    cold_start_trips: int = 7
    stable_delta_cv: float = 0.05
    stable_trips: int = 3
    gamma_below_samples: int = 30
    quarantine_speed_mps: float = 340.0
    quarantine_mad_multiplier: float = 5.0
    quarantine_floor_mps: float = 300.0


@dataclass(frozen=True)
class RiskRules:
    horizons_s: tuple[int, ...] = (120, 360, 600, 840)
    coverage_ratio: float = 1.0
    max_coverage_gap_s: float = 180.0
    warmup_trips: int = 7
    min_baseline_samples: int = 10
    mad_multiplier: float = 3.0
    min_p95_exceedances: int = 2
    zero_mad_penalty: float = 10.0
    zero_mad_epsilon: float = 1e-6
    min_valid_features: int = 3
    train_ratio: float = 0.70
    val_ratio: float = 0.15
    unseen_user_ratio: float = 0.20
    seed: int = 42


@dataclass(frozen=True)
class ModelRules:
    """Learner settings of the three model families (boosted, forest, wide boosted)."""

    boosted_step: float = 0.05
    boosted_depth: int = 5
    boosted_rounds: int = 200
    # Candidates are screened with fewer rounds or trees; the best is fitted in full.
    # Fixed values, wide boosted trees: depth, least rows of a leaf, step.
    wide_candidates: tuple[tuple[int, int, float], ...] = ((6, 30, 0.05), (8, 50, 0.05), (6, 20, 0.03))
    wide_screen_rounds: int = 100
    wide_rounds: int = 250
    wide_inputs: float = 0.7
    subsample: float = 0.8
    # Fixed values, forest: depth, least rows of a leaf.
    forest_candidates: tuple[tuple[int, int], ...] = ((12, 10), (14, 5), (10, 20))
    forest_screen_trees: int = 40
    forest_trees: int = 100
    seed: int = 42


@dataclass(frozen=True)
class ZoneRules:
    familiar_trips: int = 7
    anchor_expansion: float = 1.0
    anchor_min_radius_m: float = 25.0
    buffer_m: float = 0.0


@dataclass(frozen=True)
class LoopRules:
    history_s: int = 1200
    history_points: int = 500
    min_duration_s: float = 120.0
    min_points: int = 6
    min_path_m: float = 35.0
    min_speed_mps: float = 0.3
    max_radius_m: float = 250.0
    min_closure: float = 0.60
    min_cycles: float = 1.3
    revisit_m: float = 25.0
    revisit_gap_s: float = 30.0
    max_accuracy_m: float = 25.0
    stale_gap_s: float = 300.0


@dataclass(frozen=True)
class HeartRules:
    """Personal heart-rate evidence; ``group()`` is the second parameter set in use."""

    freshness_s: float = 60.0
    min_samples: int = 10
    last_readings: int = 500
    std_floor: float = 3.0
    elevated_z: float = 2.0
    resting_speed_mps: float = 0.8
    min_bpm: int = 30
    max_bpm: int = 250
    tachycardia_bpm: int | None = None

    @staticmethod
    def group() -> "HeartRules":
        return HeartRules(min_samples=5, last_readings=50, std_floor=2.0, tachycardia_bpm=100)


@dataclass(frozen=True)
class GeofenceRules:
    exit_readings: int = 2
    reentry_readings: int = 2
    max_accuracy_m: float = 25.0
    buffer_m: float = 15.0
    buffer_cap_m: float = 20.0
    alert_tier: int = 3


@dataclass(frozen=True)
class GroupRules:
    separation_m: float = 50.0
    separated_readings: int = 2
    united_readings: int = 2
    max_accuracy_m: float = 25.0
    max_age_s: float = 60.0
    warning_ticks: int = 2
    alert_ticks: int = 4


@dataclass(frozen=True)
class EscalationRules:
    windows: int = 2
    min_confidence: float = 0.75
    max_gap_s: float = 180.0
    max_errors: int = 3
    patterns: tuple[str, ...] = ("PACING", "RANDOM_DRIFT")
    score_pattern: float = 65.0
    score_heart: float = 70.0
    score_heart_sustained: float = 85.0


@dataclass(frozen=True)
class PdrRules:
    up_to_transition_m: float = 27.0
    down_to_indoor_m: float = 23.0
    up_to_untracked_m: float = 52.0
    down_to_transition_m: float = 48.0


@dataclass(frozen=True)
class DismissalRules:
    decay_days: int = 30
    max_dismissals: int = 3
    step: float = 0.10
    floor: float = 0.30


@dataclass(frozen=True)
class ScoringRules:
    quiescent_below: float = 35.0
    critical_from: float = 70.0
    operational_cuts: tuple[float, float, float] = (34.0, 64.0, 84.0)
    battery_lock_pct: int = 15
    last_gasp_pct: int = 5
    pulse_burst_s: int = 5
    pulse_burst_hz: int = 1
    pulse_sleep_s: int = 175
    frozen_default: float = 20.0
    blind_spot_s: float = 900.0
