import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import segments, states
from tracewell.functions import geo
from tracewell.plans.stream_queries import finish
from tracewell.streaming import jobs

SCHEMA = (
    "user_id string, event_id bigint, t_us bigint, latitude double, longitude double, accuracy_m double, "
    "is_degraded boolean, net_displacement_m double, score double"
)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Readings of two users in four files, so that state has to survive micro-batches."""
    rng = random.Random(8)
    rows, t = [], {"a": 0, "b": 500}
    for i in range(400):
        u = rng.choice("ab")
        t[u] += rng.choice([1, 20, 60, 140, 290, 310])
        rows.append((
            u, i, t[u] * 1_000_000, 39.9 + rng.uniform(-1, 1) / 700, 116.3 + rng.uniform(-1, 1) / 700, float(rng.choice([5, 5, 5, 18, 40])),
            rng.random() < 0.15, rng.uniform(0, 70), None if rng.random() < 0.3 else float(rng.randint(0, 99)),
        ))
    path = tmp_path_factory.mktemp("events")
    for n in range(4):
        spark.createDataFrame(rows[100 * n:100 * (n + 1)], SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
    df = spark.createDataFrame(rows, SCHEMA)
    stream = (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
        .withColumn("event_time", F.timestamp_micros("t_us"))
    )
    zone = spark.createDataFrame(
        [("a", "z1", "home", 39.9, 116.3, 80.0), ("a", "z2", "work", 39.901, 116.3, 60.0), ("b", "z3", "home", 39.9, 116.3, 100.0)],
        "user_id string, zone_id string, name string, center_lat double, center_lng double, radius_m double",
    ).withColumns({"geometry_type": F.lit("CIRCLE"), "is_enabled": F.lit(True),
                   "vertices": F.lit(None).cast("array<struct<lat:double,lng:double>>")})
    return df, stream, zone


def test_window_stream_equals_batch(spark, source):
    df, stream, _ = source
    pts = df.select(
        "user_id", F.concat("user_id", F.lit("_stream")).alias("trajectory_id"), geo.from_micros("t_us").alias("timestamp"),
        F.col("event_id").alias("subsecond_seq"), "latitude", "longitude",
    )
    batch = segments.window_table(segments.segment_points(pts))
    want = {r["window_id"]: (r["point_count"], r["first_us"], r["last_us"], r["is_full_window"]) for r in batch.collect()}
    # Files may be read in any order; only an in-order source can be compared row by row.
    got = {r["window_id"]: (r["point_count"], r["first_us"], r["last_us"], r["is_full_window"])
           for r in finish(jobs.window_stream(ordered(spark, df))).collect()}
    assert len(got) > 20 and all(want[k] == v for k, v in got.items())
    last = {u: max(k for k in want if k.startswith(u)) for u in "ab"}
    missing = set(want) - set(got)
    assert missing <= {k for k in want if any(k.split("_w")[0] == v.split("_w")[0] for v in last.values())}


def ordered(spark, df):
    import tempfile
    import time

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for lo in range(0, 400, 100):
        df.where(F.col("event_id").between(lo, lo + 99)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in order of their modification time
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn(
        "event_time", F.timestamp_micros("t_us"))


def test_monitor_stream_equals_batch(spark, source):
    df, _, zone = source
    got = finish(jobs.monitor_stream(ordered(spark, df), zone))
    fence = states.geofence_states(df, zone).select("event_id", "zone_id", "state", "action", "status")
    assert rows(got.select("event_id", "zone_id", "state", "action", "status")) == rows(fence)
    pdr = states.pdr_tiers(df).select("event_id", "pdr_tier")
    assert rows(got.where("pdr_tier is not null").select("event_id", "pdr_tier").distinct()) == rows(pdr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_late_copies_are_ignored(spark, source):
    df, stream, zone = source
    twice = stream.withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_c")
    once = finish(jobs.deduplicated(twice))
    assert once.groupBy("user_id", "t_us").count().where("count > 1").count() == 0


def test_the_closing_row_comes_with_the_last_slice(spark, tmp_path):
    from tracewell.plans import adapter

    rows = spark.range(1000).selectExpr("CAST(id % 7 AS STRING) AS user_id", "id AS event_id", "id * 1000000 AS t_us")
    stream = adapter.arrivals(spark, rows)
    q = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    counts = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert len(counts) == 5 and sum(counts) == 1001 and min(counts) > 150  # six with one for the last row before
    got = {(r.event_id, r.user_id) for r in spark.table("arrived").collect()}
    assert got == {(i, str(i % 7)) for i in range(1000)} | {(-1, jobs.CLOSING_USER)}


def test_independent_jobs_run_side_by_side(spark):
    from threading import Barrier

    from tracewell.session import side_by_side

    meet = Barrier(3)  # broken if they came one after the other
    assert side_by_side(spark, *(lambda n=n: meet.wait(20) and 0 or spark.range(n).count() for n in (1, 2, 3))) == [1, 2, 3]


def test_zones_may_be_gathered_before(spark, source):
    from tracewell.operators.zones import with_zone_distances, zones_by_user

    df, _, zone = source
    a, b = (with_zone_distances(df, z).select("event_id", "zone_distances").orderBy("event_id").collect() for z in (zone, zones_by_user(zone)))
    norm = lambda rows: [(r[0], sorted(r[1] or [])) for r in rows]
    assert norm(a) == norm(b)
