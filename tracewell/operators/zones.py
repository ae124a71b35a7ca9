"""Safe zones and familiar places around a position.

Zones and anchors are configuration-sized lists per user; they are gathered into one row per user
so that a reading is joined once and never multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.config import ZoneRules
from tracewell.functions import geo
from tracewell.operators.cleaning import zone_problem

ZONE_FIELDS = ("zone_id", "name", "geometry_type", "center_lat", "center_lng", "radius_m", "vertices")


def usable_zones(zones: DataFrame) -> DataFrame:
    """Enabled zones with a valid geometry."""
    return zones.where(F.col("is_enabled") & zone_problem().isNull())


def zones_by_user(zones: DataFrame) -> DataFrame:
    return usable_zones(zones).groupBy("user_id").agg(
        F.collect_list(F.struct(*ZONE_FIELDS)).alias("zones")
    )


def with_zone_distances(
    readings: DataFrame, zones: DataFrame, spread_by: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``zone_distances``: array of (distance, name, zone_id, inside), null without zones.

    The distance is signed, negative inside.  A position exactly on a polygon edge has distance
    zero and may still be outside.  ``spread_by`` names the keys a later stage groups by: rows are
    then shuffled before the geometry is computed instead of after it.  ``zones`` may be gathered
    already (:func:`zones_by_user`), which spares every batch of a stream the gathering.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    scale = (F.col("_kx"), F.col("_ky"))
    poly = lambda z: z["geometry_type"] == "POLYGON"
    raw = F.transform(
        "zones",
        lambda z: F.struct(
            F.when(poly(z), geo.polygon_edge_distance(z["vertices"], lat, lon, scale))
            .otherwise(geo.haversine(lat, lon, z["center_lat"], z["center_lng"]) - z["radius_m"])
            .alias("d"),
            F.when(poly(z), geo.polygon_contains(z["vertices"], lat, lon)).alias("in_ring"),
            z["name"].alias("name"),
            z["zone_id"].alias("zone_id"),
        ),
    )
    signed = F.transform(
        "_raw",
        lambda z: F.struct(
            F.when(z["in_ring"], -z["d"]).otherwise(z["d"]).alias("distance"),
            z["name"].alias("name"),
            z["zone_id"].alias("zone_id"),
            F.coalesce(z["in_ring"], z["d"] <= 0).alias("inside"),
        ),
    )
    kx, ky = geo.local_scale("latitude")
    gathered = zones if "zones" in zones.columns else zones_by_user(zones)
    joined = readings.join(gathered, "user_id", "left")
    if spread_by:
        joined = joined.repartition(*spread_by)
    joined = joined.withColumns({"_kx": kx, "_ky": ky})
    return joined.withColumn("_raw", raw).withColumn("zone_distances", signed).drop(
        "zones", "_raw", "_kx", "_ky"
    )


def safe_area(readings: DataFrame, zones: DataFrame, rules: ZoneRules = ZoneRules()) -> DataFrame:
    """State against the union of zones: deepest inside, else nearest outside."""
    d = F.col("zone_distances")
    known = d.isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    held = lambda z: z["inside"] | ((z["distance"] <= rules.buffer_m) & F.lit(rules.buffer_m > 0))
    inside = F.array_min(F.filter(d, held))
    nearest = F.coalesce(inside, F.array_min(d))
    out = with_zone_distances(readings, zones).withColumns({"_in": inside, "_best": nearest})
    state = (
        F.when(~known, "SAFE_AREA_UNAVAILABLE")
        .when(F.col("_in").isNotNull(), "INSIDE_SAFE_AREA")
        .otherwise("OUTSIDE_SAFE_AREA")
    )
    return out.withColumns({
        "safe_area_state": state,
        "distance_to_safe_boundary_m": F.when(known, F.round("_best.distance", 1)),
        "matched_safe_area_name": F.when(known, F.col("_best.name")),
    }).drop("_in", "_best", "zone_distances")


def familiarity(readings: DataFrame, profiles: DataFrame, rules: ZoneRules = ZoneRules()) -> DataFrame:
    """State against learned anchors.

    ``profiles`` has ``user_id, trip_count, anchors`` with anchors as
    array<struct<anchor_id, center_latitude, center_longitude, radius_m, status>>.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    joined = readings.join(
        profiles.select("user_id", F.col("trip_count").alias("_trips"), F.col("anchors").alias("_anchors")),
        "user_id",
        "left",
    )
    each = F.transform(
        "_anchors",
        lambda a: F.struct(
            geo.haversine(lat, lon, a["center_latitude"], a["center_longitude"]).alias("distance"),
            a["anchor_id"].alias("anchor_id"),
            a["status"].alias("status"),
            F.greatest(
                a["radius_m"] * rules.anchor_expansion, F.lit(rules.anchor_min_radius_m)
            ).alias("reach"),
        ),
    )
    measured = joined.withColumn("_each", each)
    measured = measured.withColumns({
        "_near": F.array_min("_each"),
        "_hit": F.exists("_each", lambda a: a["distance"] <= a["reach"]),
    })
    trips = F.coalesce("_trips", F.lit(0))
    state = (
        F.when(lat.isNull() | lon.isNull(), "INSUFFICIENT_EVIDENCE")
        .when(trips == 0, "NO_HISTORY")
        .when(
            (trips < rules.familiar_trips) | F.col("_anchors").isNull() | (F.size("_anchors") == 0),
            "INSUFFICIENT_EVIDENCE",
        )
        .when(F.col("_hit"), "FAMILIAR_LOCATION")
        .otherwise("UNFAMILIAR_LOCATION")
    )
    measured = measured.withColumns({"familiarity_state": state, "trip_count": trips})
    judged = F.col("familiarity_state").isin("FAMILIAR_LOCATION", "UNFAMILIAR_LOCATION")
    return measured.withColumns({
        "nearest_anchor_id": F.when(judged, F.col("_near.anchor_id")),
        "distance_to_nearest_anchor_m": F.when(judged, F.round("_near.distance", 1)),
        "nearest_anchor_status": F.when(judged, F.col("_near.status")),
        "is_caregiver_confirmed": F.coalesce(
            judged & (F.col("_near.status") == "CAREGIVER_CONFIRMED"), F.lit(False)
        ),
    }).drop("_trips", "_anchors", "_each", "_near", "_hit")


def spatial_context(
    readings: DataFrame, zones: DataFrame, profiles: DataFrame, rules: ZoneRules = ZoneRules()
) -> DataFrame:
    """Both views of a position in one record."""
    return familiarity(safe_area(readings, zones, rules), profiles, rules)
