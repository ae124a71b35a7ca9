import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import geo
from tracewell.functions.automaton import run_machine
from tracewell.functions.quantiles import distribution, percentiles, spread
from tracewell.functions.scan import (
    last_seen,
    max_before,
    ordered_scan,
    previous,
    running_max,
    running_sum,
    seen_before,
)
from tracewell.operators import machines as m


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.gauss(0, 5), 1.0, 2.0])) for _ in range(4000)]
    rows += [("cold", rng.gauss(0, 1)) for _ in range(50)] + [("one", 4.0), ("none", None)]
    rows += [("same", 7.5)] * 900
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_percentiles_are_exact_for_small_and_hot_groups(numbers):
    rows, df = numbers
    probs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {r["k"]: r for r in percentiles(df, ["k"], "v", probs).collect()}
    for k in ("hot", "cold", "one", "same"):
        values = [v for key, v in rows if key == k]
        assert got[k]["n"] == len(values)
        assert np.allclose(got[k]["q"], np.percentile(values, [100 * p for p in probs]), atol=1e-9)
    assert "none" not in got


def test_spread_and_distribution_without_keys_when_hot(numbers):
    rows, df = numbers
    v = np.array([x for _, x in rows if x is not None])
    s = spread(df, [], "v").first()
    med = np.median(v)
    assert s["median"] == pytest.approx(med)
    assert s["mad"] == pytest.approx(np.median(np.abs(v - med)))
    d = distribution(df, [], "v").first()
    assert d["p95"] == pytest.approx(np.percentile(v, 95)) and d["std"] == pytest.approx(v.std())


def test_percentiles_keep_null_keys_and_extreme_values(spark):
    rows = [(None, x) for x in (-1e300, -5e-324, 0.0, -0.0, 5e-324, 3.0, 1e300)] + [("k", -2.0), ("k", -1.0)]
    got = {r["k"]: r for r in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got[None]["n"] == 7 and got[None]["q"] == [-1e300, 0.0, 1e300]
    assert got["k"]["q"] == [-2.0, -1.5, -1.0]


def test_scan_equals_plain_window(spark):
    rng = random.Random(5)
    rows = [(f"u{i % 3}", t, i, rng.choice([None, rng.randint(0, 9)])) for i, t in enumerate(rng.choices(range(500), k=400))]
    df = spark.createDataFrame(rows, "k string, t bigint, i int, x int")
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("x")
    plain = df.select(
        "*",
        F.coalesce(F.sum("x").over(upto), F.lit(0)).alias("s"),
        F.max("x").over(upto).alias("m"),
        F.max("x").over(earlier).alias("mb"),
        F.last("x", True).over(upto).alias("l"),
        F.last("x", True).over(earlier).alias("b"),
        F.lag("x").over(w).alias("p"),
    )
    for size in (7, 1000):
        got = ordered_scan(
            df, ["k"], ["t", "i"], F.floor(F.col("t") / size),
            {"s": running_sum(x), "m": running_max(x), "mb": max_before(x), "l": last_seen(x), "b": seen_before(x), "p": previous(x)},
        )
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize(
    "machine", [m.pdr_machine(), m.geofence_machine(), m.loop_machine(), m.group_machine(), m.escalation_machine()],
    ids=["pdr", "fence", "loop", "group", "escalation"],
)
def test_machine_replay_equals_a_loop(spark, machine):
    rng = random.Random(11)
    rows = [(f"u{i % 2}", i, rng.randrange(machine.symbols)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t bigint, x int")
    want = {}
    for k in ("u0", "u1"):
        s = machine.start
        for _, t, x in (r for r in rows if r[0] == k):
            b, s = s, machine.step(s, x)
            want[t] = (machine.states[b], machine.states[s])
    for size in (13, 10_000):
        got = run_machine(df, ["k"], ["t"], F.floor(F.col("t") / size), F.col("x"), machine)
        assert {r["t"]: (r["state_before"], r["state_after"]) for r in got.collect()} == want


def test_replay_cuts_a_hot_key_and_counts_rows_without_one(spark):
    """One key in one chunk meets several partitions; rows without key, time or symbol stay, with null states."""
    machine, rng = m.geofence_machine(), random.Random(5)
    rows = [("hot", i, rng.randrange(16)) for i in range(400)] + [("cold", 3, 1)]
    lost = [(None, 7, 1), ("hot", None, 1), ("hot", 9, None), (None, None, None)]
    df = spark.createDataFrame(rows + lost, "k string, t bigint, x int")
    got = run_machine(df, ["k"], ["t"], F.when(F.col("t").isNotNull(), 0), F.col("x"), machine).collect()
    assert len(got) == len(rows) + len(lost)
    assert sorted(map(str, (tuple(r)[:3] for r in got if r["state_after"] is None))) == sorted(map(str, lost))
    s, want = machine.start, []
    for _, t, x in rows[:400]:
        b, s = s, machine.step(s, x)
        want.append((t, machine.states[b], machine.states[s]))
    assert sorted((r["t"], r["state_before"], r["state_after"]) for r in got if r["k"] == "hot" and r["state_after"]) == want
    assert run_machine(df.limit(0), ["k"], ["t"], F.col("t"), F.col("x"), machine).collect() == []


def test_displacement_golden():
    machine, s, tiers = m.pdr_machine(), 0, []
    for d in (10, 30, 25, 60, 49, 40):
        s = machine.step(s, m.pdr_symbol(d))
        tiers.append(s)
    assert tiers == [0, 1, 1, 2, 2, 1]


def test_geometry_goldens(spark):
    one = spark.range(1)
    span = geo.circular_span(F.array(F.lit(179.9), F.lit(-179.9)))
    assert one.select(span.alias("s")).first()["s"] == pytest.approx(0.2)
    pair = spark.createDataFrame([(50.0, 179.9), (50.0, -179.9)], "lat double, lon double")
    x, y, z = geo.unit_vector("lat", "lon")
    g = pair.agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z")).select(
        geo.centroid_lat("x", "y", "z").alias("lat"), geo.centroid_lon("x", "y").alias("lon")
    ).first()
    assert g["lat"] == pytest.approx(50, abs=1e-3) and abs(g["lon"]) == pytest.approx(180)
    assert one.select(geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("d")).first()["d"] is None


def test_hexagons_are_even(spark):
    rng = random.Random(2)
    rows = [(10 + rng.random() * 0.2, 20 + rng.random() * 0.2) for _ in range(4000)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("c", geo.hex_cell("lat", "lon"))
    size = df.groupBy("c").agg(
        F.max(geo.haversine("lat", "lon", F.lit(10.1), F.lit(20.1))).alias("a"), (F.max("lat") - F.min("lat")).alias("h")
    )
    assert size.agg(F.max("h")).first()[0] * 111_195 <= 2 * 201 + 1
    area = 1.5 * math.sqrt(3) * 201**2
    assert 0.9e5 < area < 1.2e5


def test_polygon(spark):
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0))])
    df = spark.createDataFrame([(0.5, 0.5, True), (1.5, 0.5, False), (0.5, -0.1, False)], "lat double, lon double, inside boolean")
    got = df.select("inside", geo.polygon_contains(ring, F.col("lat"), F.col("lon")).alias("g"),
                    geo.polygon_edge_distance(ring, F.col("lat"), F.col("lon")).alias("d")).collect()
    assert all(r["g"] == r["inside"] for r in got)
    assert got[2]["d"] == pytest.approx(0.1 * 111412.84 * math.cos(math.radians(0.5)), rel=1e-6)


def test_percentiles_of_times_and_longitudes(spark):
    """Values of one size: all in one bucket, told apart by their place in it."""
    rng = np.random.default_rng(12)
    times = 1_700_000_000 + rng.integers(0, 4_000_000, 5000).astype(float)
    lons = 116.3 + rng.normal(0, 1e-3, 5000)
    rows = [("t", float(v)) for v in times] + [("l", float(v)) for v in lons] + [("same", 5.0)] * 40
    probs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["q"] for r in percentiles(df, ["k"], "v", probs).collect()}
    for k, values in (("t", times), ("l", lons), ("same", np.array([5.0]))):
        assert np.allclose(got[k], np.percentile(values, [100 * p for p in probs]), rtol=0, atol=1e-6)
    s = {r["k"]: r for r in spread(df, ["k"], "v").collect()}
    assert s["t"]["mad"] == pytest.approx(np.median(np.abs(times - np.median(times))), abs=1e-6)
    assert s["l"]["variance"] == pytest.approx(lons.var(ddof=1), rel=1e-6)


def test_percentile_between_equal_values_is_that_value(spark):
    """No value may exceed a percentile that lies between two copies of it."""
    v = 0.7739760316291208
    df = spark.createDataFrame([(n, x) for n in (20, 33, 43) for x in [0.1] * (n - 12) + [v] * 12], "k int, v double")
    assert all(r["q"] == [v, v] for r in percentiles(df, ["k"], "v", [0.95, 0.9]).collect())


def test_entropy_has_no_error_of_divided_logarithms(spark):
    import math

    from tracewell.operators.features import _entropy_bits

    rows = [(float(o), float(n)) for n in range(1, 40) for o in range(n + 1)]
    df = spark.createDataFrame(rows, "o double, n double").selectExpr("o / n AS p", "1 - o / n AS q")
    for r in df.withColumn("bits", _entropy_bits("p", "q")).collect():
        assert r.bits == sum(-x * math.log2(x) if x > 0 else 0.0 for x in (r.p, r.q))
    old = df.selectExpr("p", "log2(p) AS l").where("p > 0").collect()
    assert any(r.l != math.log2(r.p) for r in old)  # what the query used before


def test_small_groups_of_a_spread_take_one_shuffle_and_equal_the_buckets(spark, monkeypatch):
    from tracewell.functions import quantiles

    rows = [(k, float(v % m)) for k, m, n in (("a", 7, 30), ("b", 50, 9), (None, 3, 5), ("d", 2, 1)) for v in range(n)]
    df = spark.createDataFrame(rows, "k string, v double")
    gathered = spread(df, ["k"], "v")
    assert str(gathered._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    near = lambda d: {r["k"]: [None if x is None else round(x, 9) for x in r[1:]] for r in d.collect()}
    want = near(gathered)
    for limit in (0, 5):  # all and some groups by buckets
        monkeypatch.setattr(quantiles, "GATHERED", limit)
        assert near(spread(df, ["k"], "v")) == want
    assert want["b"][:5] == [9, 4.0, 7.6, 7.92, 4.0] and want["d"][5] is None and None in want
