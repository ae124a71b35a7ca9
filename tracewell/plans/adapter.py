"""Positions, readings and reference tables derived from the driver's ``events`` table.

The driver's tables hold no coordinates, so every event is turned into a position with integer
arithmetic; the SQL oracles use the same formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import geo

TRIP_US = 259_200_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def base(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf, "events") if events is None else events
    return e.select(
        "event_id",
        F.col("user_id").alias("uid"),
        geo.micros("ts").alias("us"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        "event_type",
    )


def points(
    spark: SparkSession, sf: str, squeeze: int = 1000, events: DataFrame | None = None
) -> DataFrame:
    """Positions of 3-day trips whose clock runs ``squeeze`` times faster than the events'."""
    b = base(spark, sf, events).withColumn("_b", F.expr(f"us - us % {TRIP_US}"))
    return b.select(
        "event_id",
        F.col("uid").cast("string").alias("user_id"),
        F.concat_ws("_", "uid", F.expr(f"_b div {TRIP_US}")).alias("trajectory_id"),
        geo.from_micros(F.expr(f"_b + (us - _b) div {squeeze}")).alias("timestamp"),
        F.col("event_id").alias("subsecond_seq"),
        F.expr("39.9D + (uid % 40) * 0.01D + (k - 50) * 0.00002D").alias("latitude"),
        F.expr("116.3D + (uid % 25) * 0.01D + ((v % 100) - 50) * 0.00002D").alias("longitude"),
        "uid",
        "k",
        "v",
        "event_type",
    )


def raw_points(spark: SparkSession, sf: str) -> DataFrame:
    """Raw fixes with the faults the cleaning rules remove: bad values, copies and repeats."""
    p = points(spark, sf, 250)
    faulty = p.select(
        "user_id",
        "trajectory_id",
        F.expr(
            "CASE WHEN k = 17 THEN NULL WHEN k = 19 THEN TIMESTAMP_NTZ'2000-01-01 00:00:00' "
            "ELSE date_trunc('SECOND', timestamp) END"
        ).cast("timestamp_ntz").alias("timestamp"),
        F.expr("CASE WHEN k = 7 THEN NULL WHEN k = 13 THEN 95.0D ELSE latitude END").alias("latitude"),
        "longitude",
        F.expr("CASE WHEN k % 10 = 0 THEN -777.0D ELSE v * 1.0D END").alias("altitude"),
        "k",
        F.col("event_id").alias("pos"),
    )
    copies = faulty.where("k % 11 = 0").withColumn("pos", F.col("pos") + 1_000_000_000)
    repeats = faulty.where("k % 9 = 0").withColumn("altitude", F.col("altitude") + 1).withColumn(
        "pos", F.col("pos") + 2_000_000_000
    )
    return faulty.unionByName(copies).unionByName(repeats)


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("uid")).distinct()


def consent(spark: SparkSession, sf: str) -> DataFrame:
    return users(spark, sf).select(
        F.col("uid").cast("string").alias("user_id"),
        F.expr("uid % 10 <> 0").alias("guardian_granted"),
        F.expr("uid % 3 = 0").alias("end_user_consent_applicable"),
        F.expr("CASE WHEN uid % 4 = 0 THEN NULL ELSE uid % 5 <> 1 END").alias("end_user_granted"),
    )


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """A circle for every user and a square for every even user; some are unusable or disabled."""
    u = users(spark, sf).withColumn("lat", F.expr("39.9D + (uid % 40) * 0.01D")).withColumn(
        "lng", F.expr("116.3D + (uid % 25) * 0.01D")
    )
    none = F.lit(None).cast("array<struct<lat:double,lng:double>>")
    circle = u.select(
        F.col("uid").cast("string").alias("user_id"),
        F.concat(F.lit("c"), "uid").alias("zone_id"),
        F.lit("home").alias("name"),
        F.lit("CIRCLE").alias("geometry_type"),
        F.col("lat").alias("center_lat"),
        F.col("lng").alias("center_lng"),
        F.expr("CASE WHEN uid % 17 = 0 THEN 0.0D ELSE 60.0D + uid % 60 END").alias("radius_m"),
        none.alias("vertices"),
        F.expr("uid % 7 <> 0").alias("is_enabled"),
    )
    corner = lambda a, b: F.struct(
        (F.col("lat") + 0.00001 + a).alias("lat"), (F.col("lng") + 0.00001 + b).alias("lng")
    )
    d = 0.0006
    square = u.where("uid % 2 = 0").select(
        F.col("uid").cast("string").alias("user_id"),
        F.concat(F.lit("p"), "uid").alias("zone_id"),
        F.lit("garden").alias("name"),
        F.lit("POLYGON").alias("geometry_type"),
        F.lit(None).cast("double").alias("center_lat"),
        F.lit(None).cast("double").alias("center_lng"),
        F.lit(None).cast("double").alias("radius_m"),
        F.array(corner(0.0, 0.0), corner(0.0, d), corner(d, d), corner(d, 0.0)).alias("vertices"),
        F.lit(True).alias("is_enabled"),
    )
    return circle.unionByName(square)


def readings(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Telemetry readings: a position with sensor values and a signal state."""
    p = points(spark, sf, events=events)
    return p.select(
        "event_id",
        "user_id",
        "uid",
        "trajectory_id",
        "timestamp",
        geo.micros("timestamp").alias("t_us"),
        "latitude",
        "longitude",
        "event_type",
        "k",
        "v",
        F.expr("5.0D + k % 30").alias("accuracy_m"),
        F.expr("k % 8 = 0").alias("is_degraded"),
        F.expr("CAST(v % 80 AS DOUBLE)").alias("net_displacement_m"),
        F.expr("(v % 60) / 10.0D").alias("speed_mps"),
        F.expr("CAST(k AS INT)").alias("battery_pct"),
    )


def wearables(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).where("event_type IN ('click', 'view')").select(
        "event_id",
        "user_id",
        "timestamp",
        geo.micros("timestamp").alias("t_us"),
        F.expr("CAST(60 + v % 90 AS INT)").alias("heart_rate_bpm"),
        F.expr("CASE WHEN k % 5 = 0 THEN 'OFF_WRIST' ELSE 'ON_WRIST' END").alias("wear_state"),
        F.lit("NOMINAL").alias("sensor_status"),
    )


def arrivals(spark: SparkSession, rows: DataFrame, slices: int = 5) -> DataFrame:
    """``rows`` as a stream of several micro-batches, many rows late but within 240 s, and a last row that closes the stream.

    A row arrives up to 240 s after its time; the arrivals are cut into slices, which are written one after the other, each in files of
    about 250,000 rows that a micro-batch takes together.  The last row comes with the last slice.
    """
    from tracewell.session import scratch_dir
    from tracewell.streaming.jobs import closing_row

    path = scratch_dir(spark)
    late = rows.withColumn("_at", F.expr("t_us + pmod(xxhash64(event_id), 240) * 1000000"))
    cuts, n = late.agg(F.percentile_approx("_at", [i / slices for i in range(1, slices)], 10_000), F.count("*")).first()
    cuts, files = cuts or [], 1 + n // (slices * 250_000)
    no = sum((F.when(F.col("_at") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    # Few large files would leave the cut to few tasks.
    spread = max(slices * files, spark.sparkContext.defaultParallelism)
    cut = late.withColumn("_slice", no).drop("_at").repartition(spread, "event_id")
    cut.write.partitionBy("_slice").parquet(f"{path}/cut")
    cut = spark.read.parquet(f"{path}/cut")
    for i in range(slices):
        part = cut.where(F.col("_slice") == i).select(*rows.columns)
        if i == slices - 1:
            part = part.unionByName(closing_row(rows))
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    return stream.withColumn("event_time", F.timestamp_micros("t_us"))
