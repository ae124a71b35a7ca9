"""Gap sessions and segment-anchored windows over clean points.

Points are shuffled once by ``(trajectory_id, hour)``; what crosses an hour border (previous fix,
segment number, segment start) comes from one summary row per hour, so a trip of any length is
spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import SegmentRules
from tracewell.functions import geo
from tracewell.functions.quantiles import distribution
from tracewell.functions.scan import ordered_scan, previous, running_sum, time_chunk

CHUNK_S = 3600


def segment_points(
    points: DataFrame, rules: SegmentRules = SegmentRules(), chunk_s: int = CHUNK_S
) -> DataFrame:
    """Add previous position, ``dt``, segment and window numbers to every point.

    New columns: ``t_us, prev_us, prev_lat, prev_lon, dt, segment_index, segment_start_us,
    window_index, segment_id``.
    """
    # The user is part of the key so that both branches below read one and the same shuffle.
    key = ["user_id", "trajectory_id"]
    gap_us = int(rules.max_gap_s * 1_000_000)
    timed = points.withColumn("t_us", geo.micros("timestamp")).withColumn("_chunk", time_chunk("t_us", chunk_s))
    w = Window.partitionBy(*key, "_chunk").orderBy("t_us", "subsecond_seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("t_us") - F.col("prev_us")) > gap_us
    local = (
        timed.withColumns({
            "prev_us": F.lag("t_us").over(w),
            "prev_lat": F.lag("latitude").over(w),
            "prev_lon": F.lag("longitude").over(w),
        })
        .withColumn("_open", F.when(opens, F.col("t_us")))
        .withColumns({
            "_local_seg": F.count("_open").over(upto),
            "_local_start": F.max("_open").over(upto),
        })
    )
    chunks = local.groupBy(*key, "_chunk").agg(
        F.min("t_us").alias("_first"),
        F.max(F.struct("t_us", "subsecond_seq", "latitude", "longitude")).alias("_last"),
        F.count("_open").alias("_opened"),
        F.max("_open").alias("_last_open"),
    )
    c = Window.partitionBy(*key).orderBy("_chunk")
    past = c.rowsBetween(Window.unboundedPreceding, -1)
    edge_opens = (F.col("_first") - F.col("_edge.t_us")) > gap_us
    carry = (
        chunks.withColumn("_edge", F.lag("_last").over(c)).withColumns({
            "_edge_open": F.when(F.col("_edge").isNull() | edge_opens, F.col("_first")),
            "_edge_count": F.when(F.col("_edge").isNull(), 0).otherwise(F.coalesce(edge_opens, F.lit(False)).cast("int")),
        })
        .withColumns({
            "_base_seg": F.coalesce(F.sum(F.col("_edge_count") + F.col("_opened")).over(past), F.lit(0))
            + F.col("_edge_count"),
            "_base_start": F.coalesce(
                "_edge_open",
                F.last(F.coalesce("_last_open", "_edge_open"), ignorenulls=True).over(past),
            ),
        })
        .select(
            *key,
            "_chunk",
            "_base_seg",
            "_base_start",
            F.col("_edge.t_us").alias("_e_us"),
            F.col("_edge.latitude").alias("_e_lat"),
            F.col("_edge.longitude").alias("_e_lon"),
        )
    )
    joined = (
        local.join(carry, [*key, "_chunk"])
        .withColumns({
            "prev_us": F.coalesce("prev_us", "_e_us"),
            "prev_lat": F.coalesce("prev_lat", "_e_lat"),
            "prev_lon": F.coalesce("prev_lon", "_e_lon"),
        })
    )
    span = F.col("t_us") - F.col("segment_start_us")
    return (
        joined.withColumns({
            "dt": F.coalesce((F.col("t_us") - F.col("prev_us")) / 1e6, F.lit(0.0)),
            "segment_index": (F.col("_base_seg") + F.col("_local_seg")).cast("int"),
            "segment_start_us": F.coalesce("_local_start", "_base_start"),
        })
        .withColumns({
            "window_index": F.floor(span / (rules.window_s * 1_000_000)).cast("int"),
            "segment_id": segment_name(),
        })
        .drop(
            "_chunk", "_open", "_local_seg", "_local_start", "_base_seg", "_base_start",
            "_e_us", "_e_lat", "_e_lon",
        )
    )


def segment_name() -> Column:
    return F.format_string("%s_s%03d", "trajectory_id", "segment_index")


def window_name() -> Column:
    return F.format_string("%s_w%04d", "segment_id", "window_index")


SEGMENT = ["user_id", "trajectory_id", "segment_index"]


def segment_table(segmented: DataFrame) -> DataFrame:
    """One row per segment: start, end, duration, points, zero and positive intervals."""
    inner = F.col("t_us") > F.col("segment_start_us")
    same = (F.col("t_us") == F.col("segment_start_us")) & (F.col("prev_us") == F.col("t_us"))
    return (
        segmented.groupBy(*SEGMENT)
        .agg(
            F.min("t_us").alias("start_us"),
            F.max("t_us").alias("end_us"),
            F.count("*").alias("point_count"),
            F.count_if(inner & (F.col("dt") > 0)).alias("positive_dt_count"),
            F.count_if((inner & (F.col("dt") == 0)) | same).alias("zero_dt_count"),
        )
        .withColumns({
            "duration_s": (F.col("end_us") - F.col("start_us")) / 1e6,
            "segment_id": segment_name(),
        })
    )


def window_table(segmented: DataFrame, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """One row per window with its type FULL, PARTIAL or DISCARDED.

    A segment holds at most one row per window number here, so the window over a segment is
    bounded by its length in time.
    """
    rows = segmented.groupBy(*SEGMENT, "window_index").agg(
        F.min("segment_start_us").alias("segment_start_us"),
        F.min("t_us").alias("first_us"),
        F.max("t_us").alias("last_us"),
        F.count("*").alias("point_count"),
    )
    return with_window_type(rows, rules)


def with_window_type(windows: DataFrame, rules: SegmentRules = SegmentRules()) -> DataFrame:
    seg = Window.partitionBy(*SEGMENT)
    w_us = rules.window_s * 1_000_000
    whole = F.floor(F.col("_length") / w_us)
    measured = windows.withColumns({
        "_length": F.max("last_us").over(seg) - F.col("segment_start_us"),
        "span_s": (F.col("last_us") - F.col("first_us")) / 1e6,
        "segment_id": segment_name(),
    })
    full = (F.col("window_index") < whole) | (F.col("_length") == (whole + 1) * w_us)
    typed = measured.withColumns({"_full": full, "raw_window_id": window_name()})
    kept = (F.col("point_count") >= rules.min_window_points) & (
        F.col("_full") | (F.col("span_s") >= rules.min_window_span_s)
    )
    named = F.when(~kept, "DISCARDED").when(F.col("_full"), "FULL").otherwise("PARTIAL")
    return typed.withColumns({
        "is_retained": kept,
        "is_full_window": F.col("_full") & kept,
        "window_type": named,
        "window_id": F.when(kept, F.col("raw_window_id")),
    }).drop("_length", "_full")


def windowed_points(
    points: DataFrame, rules: SegmentRules = SegmentRules(), chunk_s: int = CHUNK_S
) -> DataFrame:
    """The windowed point table: points with segment, window, window id and the full flag."""
    segmented = segment_points(points, rules, chunk_s)
    status = window_table(segmented, rules).select(
        *SEGMENT, "window_index", "window_id", "is_full_window"
    )
    return segmented.join(status, [*SEGMENT, "window_index"])


def jump_segments(
    points: DataFrame, rules: SegmentRules = SegmentRules(), chunk_s: int = CHUNK_S
) -> DataFrame:
    """The display split: a new part after a long pause or a long jump."""
    timed = points.withColumn("_t", geo.micros("timestamp"))
    order = ["_t", "subsecond_seq"]
    stepped = ordered_scan(
        timed,
        ["trajectory_id"],
        order,
        time_chunk("_t", chunk_s),
        {"_p": previous(F.struct("_t", "latitude", "longitude"))},
    )
    jump = geo.haversine("_p.latitude", "_p.longitude", "latitude", "longitude")
    breaks = (jump > rules.jump_distance_m) | (
        (F.col("_t") - F.col("_p._t")) / 1e6 > rules.jump_gap_s
    )
    return ordered_scan(
        stepped.withColumn("_b", F.coalesce(breaks, F.lit(False)).cast("int")),
        ["trajectory_id"],
        order,
        time_chunk("_t", chunk_s),
        {"part_index": running_sum(F.col("_b"))},
    ).drop("_t", "_p", "_b")


def segmentation_report(
    points: DataFrame, rules: SegmentRules = SegmentRules()
) -> tuple[DataFrame, DataFrame]:
    """Totals (one row) and the five distributions (one row per metric)."""
    segmented = segment_points(points, rules)
    segs, wins = segment_table(segmented), window_table(segmented, rules)
    kept = wins.where("is_retained")
    totals = (
        segs.agg(
            F.countDistinct("user_id").alias("users"),
            F.countDistinct("trajectory_id").alias("source_trajectories"),
            F.count("*").alias("continuous_segments"),
            F.sum("point_count").alias("total_points"),
            F.sum("zero_dt_count").alias("zero_dt_transitions"),
        ).crossJoin(
            wins.agg(
                F.count("*").alias("total_windows"),
                F.count_if(F.col("window_type") == "FULL").alias("full_windows"),
                F.count_if(F.col("window_type") == "PARTIAL").alias("partial_windows"),
                F.count_if(F.col("window_type") == "DISCARDED").alias("discarded_windows"),
                F.sum(F.when(F.col("is_retained"), F.col("point_count")).otherwise(0)).alias(
                    "points_assigned"
                ),
            )
        )
    )  # one row each
    gaps = segmented.where(F.col("dt") > rules.max_gap_s)

    def lane(df: DataFrame, metric: str, column: str) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), F.col(column).cast("double").alias("v"))

    long = (
        lane(segs, "segment_duration_s", "duration_s")
        .unionByName(lane(segs, "segment_point_count", "point_count"))
        .unionByName(lane(kept, "window_point_count", "point_count"))
        .unionByName(lane(kept, "window_span_s", "span_s"))
        .unionByName(lane(gaps, "temporal_gap_s", "dt"))
    )
    return totals, distribution(long, ["metric"], "v")
