"""Density clusters of trip ends (the places a user returns to), without all-pairs work.

Positions are put into cells so small that any two positions of one cell are neighbours.  A cell
with enough weight is therefore dense as a whole.  Distances are only computed for positions of
thin cells (fewer than ``min_points`` each) and for pairs of core cells that their extreme
positions do not already decide.  Components are then found over cells, not over positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import ProfileRules
from tracewell.functions import geo
from tracewell.functions.quantiles import percentiles
from tracewell.functions.scan import ordered_scan, previous, time_chunk
from tracewell.session import cut_lineage, store

M = geo.METRES_PER_DEGREE
CELL = ["user_id", "_r", "_c"]


def _grid(eps: float) -> float:
    return eps / math.sqrt(2) * 0.999


def _row_width(row: Column, side: float) -> Column:
    """Degrees of longitude per cell in a row; never wider than ``side`` metres."""
    south = row * (side / M) - 90.0
    north = south + side / M
    nearest = F.when((south <= 0) & (north >= 0), 0.0).otherwise(
        F.least(F.abs(south), F.abs(north))
    )
    return side / (M * F.greatest(F.cos(F.radians(nearest)), F.lit(0.01)))


def _with_cell(df: DataFrame, eps: float) -> DataFrame:
    side = _grid(eps)
    rows = df.withColumn("_r", F.floor((F.col("latitude") + 90.0) * (M / side)))
    return rows.withColumn(
        "_c", F.floor((F.col("longitude") + 180.0) / _row_width(F.col("_r"), side))
    )


def _probes(df: DataFrame, eps: float, lat0: str, lat1: str, lon0: str, lon1: str) -> DataFrame:
    """Add the cells that may hold a position within ``eps`` of the box (a few dozen per row)."""
    side = _grid(eps)
    reach = eps / M * 1.001
    r0 = F.floor((F.col(lat0) - reach + 90.0) * (M / side))
    r1 = F.floor((F.col(lat1) + reach + 90.0) * (M / side))
    far = F.greatest(F.abs(F.col(lat0)), F.abs(F.col(lat1))) + reach
    dlon = reach / F.greatest(F.cos(F.radians(F.least(far, F.lit(89.5)))), F.lit(0.01))
    out = df.withColumn("_pr", F.explode(F.sequence(r0, r1)))
    # A box that crosses the 180 degree line is also looked up on the other side.
    out = out.withColumn("_turn", F.explode(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0))))
    west = F.col(lon0) + F.col("_turn") - dlon
    east = F.col(lon1) + F.col("_turn") + dlon
    width = _row_width(F.col("_pr"), side)
    c0 = F.floor((F.greatest(west, F.lit(-180.0)) + 180.0) / width)
    c1 = F.floor((F.least(east, F.lit(180.0)) + 180.0) / width)
    return (
        out.where((west <= 180) & (east >= -180))
        .withColumn("_pc", F.explode(F.sequence(c0, c1)))
        .drop("_turn")
    )


def _near_pairs(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """Pairs (left, right) of one user within ``eps``; ``left`` must come from thin cells."""
    probes = _probes(left, eps, "latitude", "latitude", "longitude", "longitude").drop("_r", "_c")
    other = right.select(
        "user_id",
        F.col("_r").alias("_pr"),
        F.col("_c").alias("_pc"),
        *[F.col(c).alias(f"o_{c}") for c in right.columns if c not in CELL],
    )
    near = geo.haversine("latitude", "longitude", "o_latitude", "o_longitude") <= eps
    return probes.join(other, ["user_id", "_pr", "_pc"]).where(near).drop("_pr", "_pc")


def cluster_endpoints(endpoints: DataFrame, rules: ProfileRules = ProfileRules()) -> DataFrame:
    """Endpoints that belong to a cluster, with its label (``cluster``).

    The label is the position in (time, trip, type) order of the cluster's first core endpoint, so
    a border endpoint reachable from two clusters goes to the earlier one.
    """
    eps, enough = rules.anchor_eps_m, rules.anchor_min_points
    valid = endpoints.dropna(subset=["latitude", "longitude"])
    order = F.struct("timestamp", "trajectory_id", "endpoint_type")
    spots = store(
        _with_cell(
            valid.groupBy("user_id", "latitude", "longitude").agg(
                F.count("*").alias("w"), F.min(order).alias("first")
            ),
            eps,
        )
    )
    weights = spots.groupBy(*CELL).agg(F.sum("w").alias("_cell_w"))
    spots = spots.join(weights, CELL)
    dense = spots.where(F.col("_cell_w") >= enough).drop("_cell_w")
    thin = spots.where(F.col("_cell_w") < enough).drop("_cell_w")
    place = ["user_id", "latitude", "longitude"]
    reach = (
        _near_pairs(thin, spots.drop("_cell_w"), eps)
        .groupBy(*place)
        .agg(F.sum("o_w").alias("_n"))
        .where(F.col("_n") >= enough)
    )
    core = store(dense.unionByName(thin.join(reach.select(*place), place, "left_semi")))
    labelled = _cell_components(core, eps)
    core = core.join(labelled, CELL)
    border = (
        _near_pairs(
            thin.join(reach.select(*place), place, "left_anti").drop("w", "first"), core, eps
        )
        .groupBy(*place)
        .agg(F.min("o_label").alias("label"))
    )
    members = core.select(*place, "label").unionByName(border.select(*place, "label"))
    return valid.join(members, place).withColumnRenamed("label", "cluster")


def _cell_components(core: DataFrame, eps: float) -> DataFrame:
    """Label of every core cell: smallest ``first`` over its connected cells."""
    spot = F.struct("latitude", "longitude")
    cells = store(
        core.groupBy(*CELL).agg(
            F.min("first").alias("first"),
            F.min("latitude").alias("lat0"),
            F.max("latitude").alias("lat1"),
            F.min("longitude").alias("lon0"),
            F.max("longitude").alias("lon1"),
            F.array(
                F.min_by(spot, "latitude"),
                F.max_by(spot, "latitude"),
                F.min_by(spot, "longitude"),
                F.max_by(spot, "longitude"),
            ).alias("tips"),
        ).withColumn("id", F.concat_ws(":", *CELL))
    )
    candidates = _probes(cells, eps, "lat0", "lat1", "lon0", "lon1")
    other = cells.select(
        "user_id",
        F.col("_r").alias("_pr"),
        F.col("_c").alias("_pc"),
        *[F.col(c).alias(f"o_{c}") for c in ("id", "lat0", "lat1", "lon0", "lon1", "tips")],
    )
    pairs = candidates.join(other, ["user_id", "_pr", "_pc"]).where(F.col("id") < F.col("o_id"))
    touching = F.exists(
        "tips",
        lambda a: F.exists(
            F.col("o_tips"), lambda b: geo.haversine(a.latitude, a.longitude, b.latitude, b.longitude) <= eps
        ),
    )
    zero = F.lit(0.0)
    up = F.greatest(F.col("o_lat0") - F.col("lat1"), F.col("lat0") - F.col("o_lat1"), zero) * M
    across = F.greatest(F.col("o_lon0") - F.col("lon1"), F.col("lon0") - F.col("o_lon1"), zero)
    across = F.least(across, F.greatest(360.0 - (F.greatest("lon1", "o_lon1") - F.least("lon0", "o_lon0")), zero))
    lat = F.greatest(F.abs("lat0"), F.abs("lat1"), F.abs("o_lat0"), F.abs("o_lat1"))
    across = across * M * F.cos(F.radians(F.least(lat, F.lit(90.0))))
    apart = F.sqrt(up * up + across * across) * 0.995 > eps
    judged = store(
        pairs.select("user_id", "id", "o_id", touching.alias("near"), apart.alias("far"))
    )
    sure = judged.where("near").select(F.col("id").alias("a"), F.col("o_id").alias("b"))
    # Boxes close, tips not: only these pairs of cells compare their positions.
    unsure = judged.where(~F.col("near") & ~F.col("far")).select("user_id", "id", "o_id")
    where_in = core.withColumn("id", F.concat_ws(":", *CELL)).select("id", "latitude", "longitude")
    there = where_in.select(
        F.col("id").alias("o_id"),
        F.col("latitude").alias("o_latitude"),
        F.col("longitude").alias("o_longitude"),
    )
    found = (
        unsure.join(where_in, "id")
        .join(there, "o_id")
        .where(geo.haversine("latitude", "longitude", "o_latitude", "o_longitude") <= eps)
        .select(F.col("id").alias("a"), F.col("o_id").alias("b"))
        .distinct()
    )
    one_way = sure.unionByName(found)
    edges = store(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cells.select("id", F.struct("first", F.col("id").alias("root")).alias("label"))
    if not edges.isEmpty():
        labels = _spread_labels(labels, edges)
    return cells.select(*CELL, "id").join(labels, "id").select(*CELL, F.col("label.first").alias("label"))


def _spread_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label over each component.  Jumping to the root's label halves chains, so the
    number of rounds grows with the logarithm of a component's length."""
    while True:
        heard = (
            edges.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("heard"))
        )
        moved = labels.join(heard, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", "heard").alias("label")
        )
        roots = moved.select(F.col("id").alias("root"), F.col("label").alias("root_label"))
        jumped = (
            moved.withColumn("root", F.col("label.root"))
            .join(roots, "root")
            .select("id", "old", F.least("label", "root_label").alias("label"))
        )
        jumped = cut_lineage(jumped)
        labels = jumped.select("id", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def count_visits(clustered: DataFrame, rules: ProfileRules = ProfileRules()) -> DataFrame:
    """Distinct visits per cluster: stays between trips and stationary trips count once."""
    order = ["timestamp", "trajectory_id", "endpoint_type"]
    scanned = ordered_scan(
        clustered,
        ["user_id", "cluster"],
        order,
        time_chunk(geo.micros("timestamp"), 30 * 86_400),
        {"_p": previous(F.struct("trajectory_id", "endpoint_type"))},
    )
    p = F.col("_p")
    far = F.coalesce(F.col("path_distance_m") >= rules.stationary_path_m, F.lit(False))
    visit = (
        F.when(p.isNull(), 1)
        .when(p["trajectory_id"] == F.col("trajectory_id"), far.cast("int"))
        .when((p["endpoint_type"] == "end") & (F.col("endpoint_type") == "start"), 0)
        .otherwise(1)
    )
    return scanned.groupBy("user_id", "cluster").agg(
        F.sum(visit).alias("observation_count"), F.count("*").alias("raw_endpoint_count")
    )


def anchor_table(clustered: DataFrame, rules: ProfileRules = ProfileRules()) -> DataFrame:
    """One row per anchor: centre, radius, first and last visit, hours, visits, status, rank."""
    clustered = store(clustered)
    x, y, z = geo.unit_vector("latitude", "longitude")
    key = ["user_id", "cluster"]
    centre = clustered.groupBy(*key).agg(
        F.avg(x).alias("_x"),
        F.avg(y).alias("_y"),
        F.avg(z).alias("_z"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.array_sort(F.collect_set(F.hour("timestamp"))).alias("typical_hours"),
    )
    centre = centre.select(
        *key,
        geo.centroid_lat("_x", "_y", "_z").alias("center_latitude"),
        geo.centroid_lon("_x", "_y").alias("center_longitude"),
        "first_seen",
        "last_seen",
        "typical_hours",
    )
    offset = clustered.join(centre, key).withColumn(
        "_d", geo.haversine("center_latitude", "center_longitude", "latitude", "longitude")
    )
    radius = percentiles(offset, key, "_d", [rules.anchor_radius_quantile]).select(
        *key,
        F.greatest(F.col("q")[0], F.lit(rules.anchor_min_radius_m)).alias("radius_m"),
    )
    by_size = Window.partitionBy("user_id").orderBy(F.desc("raw_endpoint_count"), "cluster")
    status = F.when(
        F.col("observation_count") >= rules.anchor_confirmed_visits, "CONFIRMED"
    ).otherwise("PENDING_CAREGIVER_REVIEW")
    return (
        centre.join(radius, key)
        .join(count_visits(clustered, rules), key)
        .withColumn("anchor_rank", F.row_number().over(by_size) - 1)
        .withColumn("anchor_id", F.concat_ws("_", "user_id", F.lit("anchor"), "anchor_rank"))
        .withColumn("status", status)
        .drop("cluster")
    )
