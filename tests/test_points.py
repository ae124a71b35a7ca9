import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.config import SegmentRules
from tracewell.operators import behavior, cleaning, features, segments
from tracewell.sources import plt

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)
HEAD = "trace\nWGS 84\nfeet\nreserved\n0,2,255,track,0,0,2,8421376\n0\n"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def points(spark, rows):
    data = [(u, t, at(s), i, la, lo) for i, (u, t, s, la, lo) in enumerate(rows)]
    return spark.createDataFrame(
        data, "user_id string, trajectory_id string, timestamp timestamp_ntz, subsecond_seq int, latitude double, longitude double"
    )


def test_trace_files(spark, tmp_path):
    for name in ("alpha/Trajectory/t1.plt", "alpha/Trajectory/t2.plt", "beta/t3.plt", "alpha/Trajectory/labels.txt"):
        f = tmp_path / name
        os.makedirs(f.parent, exist_ok=True)
        f.write_text(HEAD + "39.9,116.3,0,492,39745.1,2008-10-24,02:09:59\n39.91,116.31,0,-777,39745.2,2008-10-24,bad\nx,1\n")
    (tmp_path / "empty").mkdir()
    found = plt.discover(spark, str(tmp_path)).orderBy("trajectory_id").collect()
    assert [(r["user_id"], r["trajectory_id"]) for r in found] == [
        ("alpha", "alpha_t1"), ("alpha", "alpha_t2"), ("beta", "beta_t3")]
    raw = plt.read_traces(spark, str(tmp_path)).where("trajectory_id = 'alpha_t1'").orderBy("pos").collect()
    assert [r["pos"] for r in raw] == [6, 7]
    assert raw[0]["timestamp"] == dt.datetime(2008, 10, 24, 2, 9, 59) and raw[1]["timestamp"] is None
    metres = plt.read_traces(spark, str(tmp_path)).select(plt.altitude_metres("altitude").alias("a")).distinct().collect()
    assert {r["a"] for r in metres} == {150.0, None}


def test_line_numbers_of_a_file_read_in_blocks(spark, tmp_path):
    """Files cut into many blocks give the line numbers of the whole file; written traces come back as they were."""
    rows = [("a", f"a_t{i % 2}", i, at(i), 39.9 + i * 1e-4, 116.3, float(i)) for i in range(400)] + [("b", "b_x", 0, None, 1.5, 2.5, None)]
    schema = "user_id string, trajectory_id string, pos bigint, timestamp timestamp_ntz, latitude double, longitude double, altitude double"
    written = plt.write_traces(spark.createDataFrame(rows, schema), str(tmp_path / "w")).collect()
    assert sorted(map(tuple, written)) == [("a/Trajectory/t0.plt", 200), ("a/Trajectory/t1.plt", 200), ("b/Trajectory/x.plt", 1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = plt.read_traces(spark, str(tmp_path / "w"))
        assert got.select(F.spark_partition_id()).distinct().count() > 1
        back = sorted((r["trajectory_id"], r["pos"], r["timestamp"], r["latitude"], r["altitude"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert back == sorted((r[1], 6 + r[2] // 2, r[3], r[4], r[6]) for r in rows[:400])


def test_cleaning_golden(spark):
    schema = "user_id string, trajectory_id string, timestamp timestamp_ntz, latitude double, longitude double, altitude double, pos bigint"
    rows = [
        ("u", "t", at(0), 39.90, 116.3, 1.0, 0), ("u", "t", at(0), 39.90, 116.3, 1.0, 1),
        ("u", "t", at(5), 39.91, 116.3, 1.0, 2), ("u", "t", at(5), 39.92, 116.3, 1.0, 3), ("u", "t", at(5), 39.91, 116.3, 2.0, 4),
    ]
    df = spark.createDataFrame(rows, schema)
    kept = cleaning.clean(df).orderBy("pos").collect()
    assert [(r["pos"], r["subsecond_seq"], r["timestamp_collision"]) for r in kept] == [(0, 0, False), (2, 0, True), (3, 1, True)]
    counts = {r["reason"]: r["n"] for r in cleaning.removal_counts(df).collect()}
    assert counts == {"exact_duplicate": 1, "same_position_duplicate": 1, "kept": 3}
    trip = cleaning.trip_intervals(cleaning.clean(df)).first()
    assert (trip["zero_dt_count"], trip["positive_dt_count"], trip["duration_s"]) == (1, 1, 5.0)
    assert cleaning.interval_distribution(cleaning.clean(df)).first()["p50"] == 5.0
    assert cleaning.clean(df.limit(0)).count() == 0


def test_windows_golden(spark):
    df = points(spark, [("u", "t", s, 39.9, 116.3) for s in (0, 60, 140)])
    seg = segments.segment_points(df)
    kinds = {r["window_index"]: r for r in segments.window_table(seg).collect()}
    assert (kinds[0]["window_type"], kinds[1]["window_type"]) == ("FULL", "PARTIAL")
    strict = {r["window_index"]: r for r in segments.window_table(seg, SegmentRules(min_window_points=2)).collect()}
    assert strict[1]["window_type"] == "DISCARDED" and strict[1]["window_id"] is None


def test_gap_is_strict(spark):
    df = points(spark, [("u", "t", s, 39.9, 116.3) for s in (0, 300, 600.001)])
    assert [r["segment_index"] for r in segments.segment_points(df).orderBy("t_us").collect()] == [0, 0, 1]


def test_chunk_size_does_not_change_segments(spark):
    rng = random.Random(1)
    rows = []
    for trip in ("a", "b"):
        t = 0.0
        for _ in range(200):
            t += rng.choice([0, 1, 30, 119, 250, 301, 4000])
            rows.append(("u", trip, t, 39.9 + rng.random() / 100, 116.3))
    df = points(spark, rows)
    cols = ["trajectory_id", "t_us", "subsecond_seq", "prev_us", "prev_lat", "dt", "segment_index", "segment_start_us", "window_index"]
    sets = [sorted(map(tuple, segments.segment_points(df, chunk_s=c).select(*cols).collect()), key=str) for c in (40, 3600, 10**7)]
    assert sets[0] == sets[1] == sets[2]


def test_feature_edge_cases(spark):
    rows = [("u", "one", 0, 39.9, 116.3)]
    rows += [("u", "two", 0, 39.9, 116.3), ("u", "two", 30, 39.9003, 116.3)]
    rows += [("u", "still", s, 39.9, 116.3) for s in range(0, 100, 10)]
    rows += [("u", "zero", 0, 39.9 + i / 1e4, 116.3) for i in range(4)]
    rows += [("u", "wrap", 10 * i, 10.0 + i * 1e-4, x) for i, x in enumerate((179.9999, -179.9999, 179.9998, -179.9998))]
    f = {r["trajectory_id"]: r for r in features.features_from_points(points(spark, rows)).collect()}
    assert f["one"]["path_distance_m"] == 0 and f["one"]["mean_speed_mps"] is None and f["one"]["dt_mean"] is None
    assert f["two"]["tortuosity_index"] == pytest.approx(1) and f["two"]["path_closure_ratio"] is None
    assert f["two"]["speed_std_dev"] is None
    assert f["still"]["tortuosity_index"] is None and f["still"]["turn_frequency"] is None
    assert f["still"]["radius_of_gyration"] == 0 and not f["still"]["is_kinematically_evaluable"]
    assert f["zero"]["mean_speed_mps"] is None and f["zero"]["zero_dt_count"] == 3 and f["zero"]["path_distance_m"] > 30
    assert f["wrap"]["bbox_width_m"] < 60
    for r in f.values():
        assert not any(isinstance(v, float) and abs(v) == float("inf") for v in r)


def test_patterns(spark):
    there = [("u", "pace", 4 * i, 39.9 + 1e-4 * (i % 12 if (i // 12) % 2 == 0 else 12 - i % 12), 116.3) for i in range(30)]
    line = [("u", "line", 4 * i, 39.9 + 1e-4 * i, 116.3) for i in range(30)]
    got = behavior.classify(features.features_from_points(points(spark, there + line)))
    kinds = {r["trajectory_id"]: r["behavior_class"] for r in got.where("window_index = 0").collect()}
    assert kinds == {"pace": "PACING", "line": "NORMAL"}


def test_nothing_in_nothing_out(spark):
    none = points(spark, [("u", "t", 0, 1.0, 1.0)]).limit(0)
    assert features.features_from_points(none).count() == 0
    assert segments.jump_segments(none).count() == 0


def test_features_ignore_later_fixes(spark):
    rng = random.Random(4)
    rows = [("u", "t", 7 * i, 39.9 + rng.random() / 1e3, 116.3 + rng.random() / 1e3) for i in range(120)]
    whole = features.features_from_points(points(spark, rows)).where("window_index < 3")
    cut = features.features_from_points(points(spark, rows[:70])).where("window_index < 3")
    assert sorted(map(str, whole.drop("is_full_window").collect())) == sorted(map(str, cut.drop("is_full_window").collect()))


def test_traces_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    line = b"39.9,116.3,0,100,39000.5,2008-10-23,02:53:%02d"
    head = b"h\r\n" * 6
    files = {
        "a/Trajectory/t1.plt": head + b"\r\n".join(line % i for i in range(30)) + b"\r\n",
        "a/Trajectory/t2.plt": b"\xef\xbb\xbf" + head + line % 1 + b"\r" + line % 2 + b"\n\n" + line % 3,  # all kinds of line ends
        "deep/er/still/b/t3.plt": head + line % 4,
        "b/empty.plt": b"", "b/_tmp/t.plt": head + line % 5, "b/.t.plt": head + line % 6, "b/t.plt.7": head + line % 7, "t4.plt": head + line % 8,
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    found = plt.discover(spark, str(tmp_path))
    assert "binaryFile" not in found._jdf.queryExecution().toString()  # its listing would pass all files through the driver
    here = {str(tmp_path / n): len(t) for n, t in files.items() if n[:5] != "b/_tm" and n[:3] != "b/." and n.endswith("plt")}
    assert {r.path: r.length for r in found.collect()} == here
    columns = ("trajectory_id", "pos", "timestamp", "latitude")
    rows = lambda: sorted(plt.read_traces(spark, str(tmp_path)).select(*columns).collect())
    whole = rows()
    assert [r.pos for r in whole if r.trajectory_id == "a_t2"] == [6, 7, 9]
    assert len(whole) == 30 + 3 + 2
    monkeypatch.setattr(plt, "WHOLE_BYTES", 500)
    assert rows() == whole  # the long file goes in blocks
    assert sorted(plt.read_traces(spark, f"{tmp_path}/*").select(*columns).collect()) == whole  # a pattern goes by Spark's reader


def test_window_medians_come_from_sorted_values(spark):
    steps = {"odd": (0, 1, 3, 10), "even": (0, 1, 3, 10, 50), "one": (0,), "same": (0, 5, 10)}
    found = features.features_from_points(points(spark, [("u", t, s, 40.0 + s / 1e4, 116.0) for t, at_s in steps.items() for s in at_s]))
    # Spark's percentile compiles a projection per group.
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.trajectory_id: (r.dt_median, r.step_distance_median, r.median_speed_mps) for r in found.collect()}
    assert {t: m[0] for t, m in got.items()} == {"odd": 2.0, "even": 4.5, "one": None, "same": 5.0}
    assert got["one"] == (None, None, None)
    assert got["odd"][1] == pytest.approx(2 * 11.1195, rel=1e-4)
    assert got["even"][2] == pytest.approx(11.1195, rel=1e-4)
