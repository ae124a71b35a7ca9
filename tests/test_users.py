import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import anchors, loops, metrics, profiles, risk, states
from tracewell.operators.asof import asof_last

T0 = dt.datetime(2024, 1, 1)


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def brute_clusters(rows, eps=150.0, enough=3):
    """Textbook density clustering; the label is the position of the first core row."""
    out = {}
    for u in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1], r[5]))
        near = [[j for j, b in enumerate(mine) if metres((a[3], a[4]), (b[3], b[4])) <= eps] for a in mine]
        core = [len(n) >= enough for n in near]
        label = [None] * len(mine)
        for i in range(len(mine)):
            if core[i] and label[i] is None:
                todo, label[i] = [i], i
                while todo:
                    for k in near[todo.pop()]:
                        if core[k] and label[k] is None:
                            label[k] = i
                            todo.append(k)
        for i in range(len(mine)):
            if not core[i]:
                label[i] = min((label[k] for k in near[i] if core[k]), default=None)
        for r, lab in zip(mine, label):
            if lab is not None:
                first = mine[lab]
                out[(r[0], r[1], r[5])] = (first[2], first[1], first[5])
    return out


@pytest.mark.parametrize("seed,lat,lon", [(1, 39.9, 116.3), (2, 0.0, 0.0), (3, -60.0, 179.9995), (4, 71.0, -179.9998)])
def test_anchor_clusters_equal_brute_force(spark, seed, lat, lon):
    rng = random.Random(seed)
    rows = []
    for u in ("a", "b"):
        spread_m = 900 if u == "a" else 2500
        for i in range(130):
            la = lat + rng.uniform(-1, 1) * spread_m / 111195
            lo = lon + rng.uniform(-1, 1) * spread_m / 111195 / math.cos(math.radians(lat))
            lo = (lo + 180) % 360 - 180
            rows.append((u, f"t{i // 2}", T0 + dt.timedelta(minutes=i), la, lo, "start" if i % 2 == 0 else "end", 500.0))
        rows += [(u, f"x{i}", T0 + dt.timedelta(days=1, minutes=i), lat, (lon + 180) % 360 - 180, "start", 1.0) for i in range(40)]
    df = spark.createDataFrame(
        rows, "user_id string, trajectory_id string, timestamp timestamp_ntz, latitude double, longitude double, endpoint_type string, path_distance_m double"
    )
    got = {
        (r["user_id"], r["trajectory_id"], r["endpoint_type"]): (r["cluster"]["timestamp"], r["cluster"]["trajectory_id"], r["cluster"]["endpoint_type"])
        for r in anchors.cluster_endpoints(df).collect()
    }
    assert got == brute_clusters(rows)


def test_stability_is_past_only_and_resets(spark):
    d = [1000.0, 1010.0, 1005.0, 1002.0, 1001.0, 1003.0, 1000.0, 1004.0, 5000.0, 1000.0, 1001.0]
    rows = [("u", f"t{i:02d}", T0 + dt.timedelta(days=i), x) for i, x in enumerate(d)]
    schema = "user_id string, trajectory_id string, start_time timestamp_ntz, path_distance_m double"
    full = profiles.stability_history(spark.createDataFrame(rows, schema)).orderBy("trip_index").collect()
    part = profiles.stability_history(spark.createDataFrame(rows[:8], schema)).orderBy("trip_index").collect()
    assert [tuple(r) for r in full[:8]] == [tuple(r) for r in part]
    prev, streak, driven = None, 0, False
    for i, r in enumerate(full, 1):
        cv = np.std(d[:i], ddof=1) / np.mean(d[:i]) if i > 1 else None
        delta = abs(cv - prev) / prev if prev is not None and cv is not None else None
        streak = streak + 1 if delta is not None and delta < 0.05 else 0
        driven = driven or (i >= 7 and streak >= 3)
        assert r["consecutive_stable_trips"] == streak and (r["status"] == "ML_DRIVEN") == driven
        assert (r["cv"] is None) == (cv is None) and (cv is None or r["cv"] == pytest.approx(cv, rel=1e-6))
        prev = cv if cv is not None else prev


def test_stability_of_long_distances_does_not_cancel(spark):
    d = [1e9 + x for x in (0.0, 3.0, 1.0, 7.0, 2.0, 5.0)]
    rows = [("u", f"t{i}", T0 + dt.timedelta(days=i), x) for i, x in enumerate(d)]
    schema = "user_id string, trajectory_id string, start_time timestamp_ntz, path_distance_m double"
    got = profiles.stability_history(spark.createDataFrame(rows, schema)).orderBy("trip_index").collect()
    assert [r["cv"] for r in got][1:] == [pytest.approx(np.std(d[:i], ddof=1) / np.mean(d[:i]), rel=1e-6) for i in range(2, 7)]


def test_fourth_dismissal_is_refused(spark):
    hour, day = 3_600_000_000, 86_400_000_000
    t = [0, hour, 2 * hour, 3 * hour, 30 * day, 30 * day + 1, 31 * day, 75 * day]
    df = spark.createDataFrame([(i, "c", x) for i, x in enumerate(t)], "event_id bigint, cell string, t_us bigint")
    got = states.dismissal_quota(df).orderBy("event_id").collect()
    assert [r["allowed"] for r in got] == [True, True, True, False, False, True, True, True]
    assert [r["count_in_window"] for r in got] == [1, 2, 3, 3, 3, 1, 2, 1]
    assert [r["clock_us"] for r in got] == [0] * 5 + [30 * day + 1] * 2 + [75 * day]
    assert got[2]["multiplier"] == pytest.approx(0.7)


def test_actual_target_golden(spark):
    rows = [(f"w{i}", "u", "t", 0, i, 120_000_000 * i, 120_000_000 * (i + 1), i == 2) for i in range(3)]
    df = spark.createDataFrame(
        rows, "window_id string, user_id string, trajectory_id string, segment_index int, window_index int, start_us bigint, end_us bigint, is_outlier boolean"
    ).withColumns({"is_evaluable": F.lit(True), "is_kinematically_evaluable": F.lit(True)})
    origin = df.where("window_index = 0").withColumn("end_us", F.lit(0).cast("bigint")).withColumn("window_id", F.lit("o")).withColumn("is_evaluable", F.lit(False))
    got = {r["window_id"]: r["target_300s"] for r in risk.actual_targets(df.unionByName(origin), 300).collect()}
    assert got["o"] is None  # the window that crosses the end gives neither evidence nor coverage
    got = {r["window_id"]: r["target_120s"] for r in risk.actual_targets(df, 120).collect()}
    assert got == {"w0": 0.0, "w1": 1.0, "w2": None}


def test_intervals_merge_across_chunks(spark):
    rng = random.Random(9)
    rows = [("k", s, s + rng.randint(0, 900)) for s in rng.choices(range(0, 40_000, 10), k=150)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    want = []
    for _, s, e in sorted(rows, key=lambda r: r[1:]):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    for size in (100, 10**9):
        got = risk.merge_intervals(df, ["k"], "s", "e", F.floor(F.col("s") / size)).orderBy("s").collect()
        assert [[r["s"], r["e"]] for r in got] == want


def test_ranking_metrics_small(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, p double")
    r = metrics.ranking_metrics(df, []).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert r["roc_auc"] == pytest.approx(auc) and r["brier_score"] == pytest.approx(np.mean([(p - y) ** 2 for y, p in rows]))
    assert metrics.ranking_metrics(df.where("y = 1"), []).first()["roc_auc"] is None


def test_threshold_table_equals_direct_count(spark):
    rng = random.Random(6)
    rows = [(rng.random() < 0.4, rng.random()) for _ in range(300)]
    df = spark.createDataFrame([(int(y), p) for y, p in rows], "y int, p double")
    grid = metrics.grid(0.1, 0.9, 9)
    got = {round(r["threshold"], 6): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in metrics.threshold_table(df, [], grid).collect()}
    for t in grid:
        tp = sum(y and p >= t for y, p in rows)
        fp = sum((not y) and p >= t for y, p in rows)
        n = sum(y for y, _ in rows)
        assert got[round(t, 6)] == (tp, fp, n - tp, len(rows) - n - fp)


def test_as_of_join(spark):
    left = spark.createDataFrame([("u", 100, 1), ("u", 200, 2), ("v", 50, 3)], "user_id string, t_us bigint, event_id bigint")
    right = spark.createDataFrame([("u", 100, 7, "a"), ("u", 150, 8, "b"), ("v", 60, 9, "c")], "user_id string, t_us bigint, event_id bigint, x string")
    got = {r["event_id"]: r["last"]["x"] if r["last"] else None for r in asof_last(left, right, ["user_id"]).collect()}
    assert got == {1: "a", 2: "b", 3: None}


def test_loop_on_a_circle(spark):
    pts = []
    for i in range(120):
        a = 2 * math.pi * i / 40
        pts.append(("u", i, i * 5_000_000, 39.9 + 3e-4 * math.sin(a), 116.3 + 3.9e-4 * math.cos(a), 5.0))
    r = spark.createDataFrame(pts, "user_id string, event_id bigint, t_us bigint, latitude double, longitude double, accuracy_m double")
    o = spark.createDataFrame([("u", 1, 119 * 5_000_000), ("u", 2, 3 * 5_000_000)], "user_id string, origin_id bigint, origin_us bigint")
    got = {x["origin_id"]: x for x in loops.loop_evidence(loops.trailing_tracks(r, o)).collect()}
    assert got[1]["pattern"] == "PERSISTENT_LOOP" and got[1]["loop_cycles"] >= 2.5 and got[1]["revisit_count"] > 50
    assert got[2]["pattern"] == "INSUFFICIENT_HISTORY"
