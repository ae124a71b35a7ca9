"""Geometry on the sphere as plain column expressions (all stay inside generated code)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import EARTH_RADIUS_M

# Metres per degree in the local plane used for polygon edges (fixed values).
LAT_M, LAT_M_2PHI, LON_M = 111132.92, 559.82, 111412.84
# Hexagon edge giving cells of about 0.105 square kilometres.
HEX_EDGE_M = 201.0
METRES_PER_DEGREE = 111194.92664455873


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col(ts))


def from_micros(us: Column | str) -> Column:
    """Zone-less timestamp for microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", col(us), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def unit_interval(c: Column) -> Column:
    """Clip to [0, 1]; null stays null (least and greatest would skip it)."""
    return F.when(c > 1, 1.0).when(c < 0, 0.0).otherwise(c)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = unit_interval(
        half_lat * half_lat
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    )
    return 2 * radius * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial compass bearing in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def signed_turn(current, previous) -> Column:
    """Heading change wrapped to [-180, 180)."""
    return F.pmod(col(current) - col(previous) + 540.0, F.lit(360.0)) - 180.0


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    p, l = F.radians(col(lat)), F.radians(col(lon))
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def centroid_lat(x, y, z) -> Column:
    x, y, z = map(col, (x, y, z))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def centroid_lon(x, y) -> Column:
    return F.degrees(F.atan2(col(y), col(x)))


def circular_span(lons: Column) -> Column:
    """Shortest arc in degrees that covers a short array of distinct longitudes."""
    s = F.array_sort(lons)
    gaps = F.zip_with(
        F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))),
        F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))),
        lambda b, a: b - a,
    )
    widest = F.greatest(
        F.array_max(gaps), 360.0 - (F.element_at(s, -1) - F.element_at(s, 1))
    )
    return F.when(F.size(s) <= 1, F.lit(0.0)).otherwise(360.0 - widest)


def circular_spans(df: DataFrame, keys: Sequence[str], lon: Column, bins: int = 3600) -> DataFrame:
    """``keys`` and ``span_deg``: the shortest arc in degrees that covers all longitudes of a key.

    The widest gap lies inside a bin or between the extremes of neighbouring bins.  A key has ``bins`` bins at most, so its rows
    are dealt over as many groups and only the bins meet in one task.
    """
    keys = list(keys)
    within = Window.partitionBy(*keys, "_bin").orderBy("_lon")
    rows = df.select(*keys, lon.alias("_lon")).where("_lon is not null").distinct()
    rows = rows.withColumn("_bin", F.floor((F.col("_lon") + 180.0) / (360.0 / bins)))
    inner = rows.withColumn("_gap", F.col("_lon") - F.lag("_lon").over(within))
    binned = inner.groupBy(*keys, "_bin").agg(F.min("_lon").alias("_a"), F.max("_lon").alias("_b"), F.max("_gap").alias("_gap"))
    across = F.col("_a") - F.lag("_b").over(Window.partitionBy(*keys).orderBy("_bin"))
    out = binned.withColumn("_across", across).groupBy(*keys).agg(
        F.greatest(F.max("_across"), F.max("_gap"), 360.0 - (F.max("_b") - F.min("_a"))).alias("_widest"),
        (F.max("_b") == F.min("_a")).alias("_one"),
    )
    return out.select(*keys, F.when(F.col("_one"), F.lit(0.0)).otherwise(360.0 - F.col("_widest")).alias("span_deg"))


def hex_cell(lat, lon) -> Column:
    """Identifier of the hexagon that holds a position.

    Positions are laid out on the equal-area sinusoidal plane and rounded in axial hexagon
    coordinates, so all cells have the same area and the id needs no lookup.
    """
    lat, lon = col(lat), col(lon)
    y = lat * METRES_PER_DEGREE
    x = lon * METRES_PER_DEGREE * F.cos(F.radians(lat))
    q = (x * 0.5773502691896258 - y / 3.0) / HEX_EDGE_M
    r = (y * 2.0 / 3.0) / HEX_EDGE_M
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    cell_q = F.when(fix_q, -rr - rs).otherwise(rq)
    cell_r = F.when(fix_r, -rq - rs).otherwise(rr)
    return F.concat_ws("_", F.lit("h9"), cell_q.cast("bigint"), cell_r.cast("bigint"))


def polygon_edges(vertices: Column) -> Column:
    """Array of (a, b) vertex pairs of a closed ring given as array<struct<lat,lng>>."""
    ring = F.concat(F.slice(vertices, 2, F.size(vertices)), F.slice(vertices, 1, 1))
    return F.arrays_zip(vertices.alias("a"), ring.alias("b"))


def polygon_contains(vertices, lat, lon) -> Column:
    """Even-odd rule over the edges that straddle the latitude of the position."""
    vertices, lat, lon = col(vertices), col(lat), col(lon)
    ring = F.concat(F.slice(vertices, 2, F.size(vertices)), F.slice(vertices, 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        straddles = (F.least(a.lat, b.lat) < lat) & (lat <= F.greatest(a.lat, b.lat))
        at = (lat - a.lat) * (b.lng - a.lng) / F.nullif(b.lat - a.lat, F.lit(0.0)) + a.lng
        return F.when(straddles & (lon <= at), 1).otherwise(0)

    hits = F.aggregate(F.zip_with(vertices, ring, crosses), F.lit(0), lambda n, c: n + c)
    return hits % 2 == 1


def local_scale(lat) -> tuple[Column, Column]:
    """Metres per degree east and north around a latitude."""
    lat = col(lat)
    return LON_M * F.cos(F.radians(lat)), LAT_M - LAT_M_2PHI * F.cos(2 * F.radians(lat))


def polygon_edge_distance(vertices, lat, lon, scale: tuple[Column, Column] | None = None) -> Column:
    """Metres from a position to the nearest edge, in a plane centred on the position.

    ``scale`` are the two columns of :func:`local_scale` when the caller has them already.
    """
    vertices, lat, lon = col(vertices), col(lat), col(lon)
    ring = F.concat(F.slice(vertices, 2, F.size(vertices)), F.slice(vertices, 1, 1))
    kx, ky = scale or local_scale(lat)

    def edge(a: Column, b: Column) -> Column:
        x1, y1 = (a.lng - lon) * kx, (a.lat - lat) * ky
        dx, dy = (b.lng - a.lng) * kx, (b.lat - a.lat) * ky
        length2 = dx * dx + dy * dy
        t = F.when(length2 == 0, 0.0).otherwise(
            unit_interval(-(x1 * dx + y1 * dy) / F.nullif(length2, F.lit(0.0)))
        )
        return F.sqrt((x1 + t * dx) * (x1 + t * dx) + (y1 + t * dy) * (y1 + t * dy))

    return F.array_min(F.zip_with(vertices, ring, edge))
