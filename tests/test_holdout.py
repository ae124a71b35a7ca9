"""Nothing is learned from unseen users, from the scored trip or from later ones."""

import threading

import pytest
from pyspark.sql import functions as F

from tracewell.config import RiskRules
from tracewell.operators import models, risk
from tracewell.plans.window_queries import feature_table
from tracewell.session import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    return store(feature_table(spark, SF))


def test_priors_and_baselines_do_not_see_unseen_users(features):
    known, unseen = risk.held_out(features)
    names = lambda df: {r.user_id for r in df.select("user_id").distinct().collect()}
    assert names(unseen) and not names(known) & names(unseen)
    assert names(known) | names(unseen) == names(features)
    changed = known.unionByName(unseen.withColumn("mean_speed_mps", F.lit(1e6)))
    key = lambda df: sorted(map(tuple, df.select("feature", "sample_size", "median", "p95").collect()))
    assert key(risk.population_prior(risk.held_out(changed)[0])) == key(risk.population_prior(known))


def test_past_baselines_ignore_the_trip_and_all_later_ones(features):
    rules = RiskRules(warmup_trips=2)
    trips = risk.numbered_trips(features).select("user_id", "trajectory_id", "trip_no")
    windows = store(features.join(trips, ["user_id", "trajectory_id"]))
    key = lambda df: sorted(map(str, df.where("base_no <= 4").collect()))
    whole = risk.past_baselines(windows, rules)
    spoilt = windows.withColumn("mean_speed_mps", F.when(F.col("trip_no") >= 4, 1e6).otherwise(F.col("mean_speed_mps")))
    assert whole.where("base_no <= 4").count() > 0
    assert key(whole) == key(risk.past_baselines(spoilt, rules))


def test_a_horizon_without_labels_has_no_model(spark):
    rows = spark.createDataFrame(
        [("w", "u", "t", "s", 1, 0, 1, 1.0)],
        "window_id string, user_id string, trajectory_id string, segment_id string, window_index int, start_us long, end_us long, a double",
    ).withColumn("target_120s", F.lit(None).cast("double"))
    for fit in (models.fit_boosted, models.fit_forest):
        fitted = fit(rows, rows, 120, columns=("a",))
        got = models.score(rows, fitted, 120).first()
        assert fitted.model is None and got.calibrated_probability is None and got.y_pred is None
        assert models.importances(fitted, spark).count() == 0


def test_horizons_are_fitted_side_by_side(spark):
    meet = threading.Barrier(2, timeout=30)  # breaks if one fit waits for the end of the other

    def fit(horizon):
        meet.wait()
        return models._nothing(str(horizon), ())

    assert {h: f.name for h, f in models.fit_horizons(fit, (120, 360), spark).items()} == {120: "120", 360: "360"}


def test_users_with_many_windows_get_the_same_past(spark, monkeypatch):
    windows = store(risk.split_windows(feature_table(spark, SF, 250)))
    sizes = sorted(r["count"] for r in windows.groupBy("user_id").count().collect())
    assert sizes[0] < sizes[-1]
    for build in (risk.past_baselines, risk.expanding_baselines):
        found = []
        for held in (sizes[-1], sizes[len(sizes) // 2] - 1, 0):  # all users by arrays, some, none
            monkeypatch.setattr(risk, "HELD", held)
            rows = build(windows)
            found.append(sorted(rows.select("user_id", "base_no", "feature", *rows.columns[3:]).collect(), key=lambda r: r[:3]))
        assert found[0] and found[0] == found[1] == found[2]
