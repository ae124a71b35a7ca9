"""Fixed schemas of the public tables and of the telemetry event."""

from __future__ import annotations

POINTS = (
    "user_id string, trajectory_id string, timestamp timestamp_ntz, latitude double, longitude double, "
    "altitude double, raw_days double, date_str string, time_str string, subsecond_seq int, "
    "timestamp_collision boolean"
)

TELEMETRY = (
    "user_id string, timestamp timestamp, "
    "location struct<lat: double, lng: double, altitude_m: double>, "
    "sensor_metrics struct<horizontal_accuracy_m: double, speed_mps: double, heading_deg: double, "
    "activity_type: string, battery_pct: int>, "
    "imu_metrics struct<step_count_since_last_gps: int, net_displacement_m: double, pdr_tier_state: string>, "
    "signal_status struct<state: string, degraded_since: timestamp>, "
    "wearable_metrics struct<heart_rate_bpm: int, timestamp: timestamp, wear_state: string, sensor_status: string>"
)

WINDOWS_OUT = (
    "user_id string, window_id string, segment_index int, window_index int, point_count bigint, "
    "first_us bigint, last_us bigint, path_distance_m double, is_full_window boolean, follows_previous boolean"
)

MONITOR_OUT = (
    "user_id string, event_id bigint, t_us bigint, zone_id string, pdr_tier string, state string, "
    "action string, status string, frozen_score double"
)
