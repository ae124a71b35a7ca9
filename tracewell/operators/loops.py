"""Persistent loops in the trailing track of a user."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.config import EARTH_RADIUS_M, FeatureRules, LoopRules
from tracewell.functions import geo


def trailing_tracks(
    readings: DataFrame, origins: DataFrame, rules: LoopRules = LoopRules()
) -> DataFrame:
    """Readings in the 1,200 s before each origin (both ends in), the last 500 of them.

    ``origins`` has ``user_id, origin_id, origin_us``.  Time bins make it an equality join, so an
    origin only meets readings of two bins.
    """
    span = rules.history_s * 1_000_000
    binned = readings.withColumn("_bin", F.floor(F.col("t_us") / span))
    asked = origins.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("origin_us") / span) - i for i in (0, 1)])))
    near = asked.join(binned, ["user_id", "_bin"]).where(
        (F.col("t_us") <= F.col("origin_us")) & (F.col("t_us") >= F.col("origin_us") - span)
    )
    newest = Window.partitionBy("origin_id").orderBy(F.desc("t_us"), F.desc("event_id"))
    return (
        near.withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= rules.history_points)
        .drop("_r", "_bin")
    )


SEEN = T.StructType(
    [T.StructField("revisits", T.IntegerType()), T.StructField("cycles", T.DoubleType())]
)


@F.pandas_udf(SEEN)
def _revisits(t: pd.Series, lat: pd.Series, lon: pd.Series, gap: pd.Series, near: pd.Series) -> pd.DataFrame:
    """For every position the first later one (two or more on) that comes back to it.

    One call sees one bounded track (at most 500 positions) as arrays.
    """
    out = []
    for ts, a, b, g, m in zip(t, lat, lon, gap, near):
        n = len(ts)
        if n < 3:
            out.append((0, None))
            continue
        ts, p, l = np.asarray(ts, float), np.radians(np.asarray(a, float)), np.radians(np.asarray(b, float))
        dp, dl = p[None, :] - p[:, None], l[None, :] - l[:, None]
        h = np.sin(dp / 2) ** 2 + np.cos(p)[:, None] * np.cos(p)[None, :] * np.sin(dl / 2) ** 2
        d = 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
        wait = ts[None, :] - ts[:, None]
        hit = np.triu((wait >= g) & (d <= m), k=2)
        found = hit.any(axis=1)
        first = hit.argmax(axis=1)
        waits = wait[np.arange(n), first][found]
        whole = ts[-1] - ts[0]
        out.append((int(found.sum()), float(np.mean(whole / waits)) if found.any() else None))
    return pd.DataFrame(out, columns=["revisits", "cycles"])


def loop_evidence(tracks: DataFrame, rules: LoopRules = LoopRules()) -> DataFrame:
    """Evidence and pattern per ``origin_id`` of a track table (see :func:`trailing_tracks`)."""
    bounds = FeatureRules()
    good = tracks.where(
        F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= rules.max_accuracy_m)
    )
    w = Window.partitionBy("origin_id").orderBy("t_us", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = good.select(
        "origin_id", "t_us", "event_id", "latitude", "longitude",
        F.lag("t_us").over(w).alias("_pt"),
        F.lag("latitude").over(w).alias("_pla"),
        F.lag("longitude").over(w).alias("_plo"),
    )
    step = geo.haversine("_pla", "_plo", "latitude", "longitude")
    x, y, z = geo.unit_vector("latitude", "longitude")
    p = p.withColumns({"_step": step, "_x": x, "_y": y, "_z": z})
    bearing = F.when(
        F.col("_step") >= bounds.min_bearing_step_m, geo.bearing("_pla", "_plo", "latitude", "longitude")
    )
    p = p.withColumns({"_b": bearing}).withColumns({
        "_turn": geo.signed_turn("_b", F.last("_b", ignorenulls=True).over(before)),
        "_cx": F.avg("_x").over(whole),
        "_cy": F.avg("_y").over(whole),
        "_cz": F.avg("_z").over(whole),
    })
    off = geo.haversine(
        "latitude", "longitude", geo.centroid_lat("_cx", "_cy", "_cz"), geo.centroid_lon("_cx", "_cy")
    )
    at, here = F.struct("t_us", "event_id"), F.struct("latitude", "longitude")
    g = p.withColumn("_off2", off * off).groupBy("origin_id").agg(
        F.count("*").alias("points"),
        ((F.max("t_us") - F.min("t_us")) / 1e6).alias("duration_sec"),
        F.max((F.col("t_us") - F.col("_pt")) / 1e6).alias("_gap"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"),
        F.min_by(here, at).alias("_a"),
        F.max_by(here, at).alias("_z"),
        F.sqrt(F.avg("_off2")).alias("rg"),
        F.coalesce(F.sum("_turn"), F.lit(0.0)).alias("net"),
        F.coalesce(F.sum(F.abs("_turn")), F.lit(0.0)).alias("total"),
        F.array_sort(F.collect_list(F.struct("t_us", "event_id", "latitude", "longitude"))).alias("_pts"),
    )
    seen = _revisits(
        F.transform("_pts", lambda r: r["t_us"] / 1e6), F.col("_pts.latitude"), F.col("_pts.longitude"),
        F.lit(rules.revisit_gap_s), F.lit(rules.revisit_m),
    )
    g = g.withColumns({
        "disp": geo.haversine("_a.latitude", "_a.longitude", "_z.latitude", "_z.longitude"),
        "_seen": seen,
    })
    g = g.withColumns({
        "speed": F.col("path") / F.greatest("duration_sec", F.lit(1.0)),
        "closure": geo.unit_interval(1 - F.col("disp") / F.greatest("path", F.lit(1e-3))),
        "revisit_count": F.col("_seen.revisits"),
        "rotation_cycles": F.abs("net") / 360.0,
    })
    cycles = F.greatest(F.col("rotation_cycles"), F.coalesce("_seen.cycles", F.lit(0.0)))
    g = g.withColumn("cycles", F.round(cycles, 2))
    return _verdict(g, rules)


def _verdict(g: DataFrame, r: LoopRules) -> DataFrame:
    c = F.col
    thin = (c("points") < r.min_points) | (c("_gap") > r.stale_gap_s)
    still = (c("speed") < r.min_speed_mps) | (c("path") < r.min_path_m)
    transit = (c("disp") > 0.6 * c("path")) | (c("rg") > r.max_radius_m)
    short = (c("duration_sec") < r.min_duration_s) | (c("cycles") < r.min_cycles)
    detour = (c("closure") >= r.min_closure) | (c("total") >= 360)
    loop = (c("closure") >= r.min_closure) & (
        (c("revisit_count") >= 1) | (c("rotation_cycles") >= 1.2)
    )
    pattern = (
        F.when(thin, "INSUFFICIENT_HISTORY")
        .when(still, "STATIONARY_JITTER")
        .when(transit, "PROGRESSIVE_TRANSIT")
        .when(short & detour, "SHORT_DETOUR")
        .when(short, "ORDINARY_TURN")
        .when(loop, "PERSISTENT_LOOP")
        .otherwise("COMPLEX_TRANSIT")
    )
    sure = (
        0.4 * F.least(F.lit(1.0), c("duration_sec") / (r.min_duration_s * 1.5))
        + 0.3 * F.least(F.lit(1.0), c("cycles") / 2.0)
        + 0.3 * c("closure")
    )
    p = c("pattern")
    confidence = (
        F.when(p.isin("INSUFFICIENT_HISTORY", "STATIONARY_JITTER"), 0.0)
        .when(p == "PROGRESSIVE_TRANSIT", 0.1)
        .when(p.isin("SHORT_DETOUR", "ORDINARY_TURN"), F.round(F.least(F.lit(0.5), c("closure") * 0.5), 2))
        .when(p == "PERSISTENT_LOOP", F.round(sure, 2))
        .otherwise(0.4)
    )
    counted = ~p.isin("INSUFFICIENT_HISTORY", "STATIONARY_JITTER")
    measured = p != "INSUFFICIENT_HISTORY"

    def shown(ok: Column, value: Column, digits: int) -> Column:
        return F.when(ok, F.round(value, digits)).otherwise(0.0)

    return g.withColumn("pattern", pattern).select(
        "origin_id",
        "pattern",
        (p == "PERSISTENT_LOOP").alias("is_looping"),
        confidence.alias("confidence"),
        F.when(counted, c("cycles")).otherwise(0.0).alias("loop_cycles"),
        F.when(c("points") < r.min_points, 0.0).otherwise(F.round("duration_sec", 1)).alias("duration_sec"),
        shown(measured, c("path"), 1).alias("path_distance_m"),
        shown(measured, c("disp"), 1).alias("straight_line_displacement_m"),
        shown(measured, c("speed"), 2).alias("mean_speed_mps"),
        shown(counted, c("rg"), 1).alias("radius_of_gyration_m"),
        shown(counted, c("closure"), 2).alias("closure_ratio"),
        shown(counted, c("net"), 1).alias("net_rotation_deg"),
        shown(counted, c("total"), 1).alias("total_angular_change_deg"),
        F.when(counted, c("revisit_count")).otherwise(0).alias("revisit_count"),
    )
