"""Learners on MLlib: boosted trees, forest and wide boosted trees, calibration and scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.config import ModelRules
from tracewell.operators import metrics
from tracewell.operators.risk import EXTENDED_PREDICTORS
from tracewell.session import store


def design(df: DataFrame, columns: Sequence[str] = EXTENDED_PREDICTORS) -> DataFrame:
    """Add ``features``: nulls become zero and are flagged, because MLlib takes no missing values."""
    filled = df.withColumns({
        **{f"_x_{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in columns},
        **{f"_m_{c}": F.col(c).isNull().cast("double") for c in columns},
    })
    names = [f"_x_{c}" for c in columns] + [f"_m_{c}" for c in columns]
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(filled)
    return assembled.drop(*names)


def weighted(df: DataFrame, label: str = "y") -> DataFrame:
    """Positive rows weigh negatives/positives (1 if all rows are of one class)."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count("*").alias("_n"))
    w = F.when((F.col(label) == 1) & (F.col("_p") > 0) & (F.col("_n") > F.col("_p")), (F.col("_n") - F.col("_p")) / F.col("_p"))
    return df.crossJoin(F.broadcast(counts)).withColumn("w", F.coalesce(w, F.lit(1.0))).drop("_p", "_n")


@dataclass
class Fitted:
    """A trained model with its calibration and operating point."""

    name: str
    model: object
    columns: tuple[str, ...]
    weight: float
    bias: float
    threshold: float


def _rows(df: DataFrame, horizon_s: int, columns: Sequence[str]) -> DataFrame:
    y = F.col(f"target_{horizon_s}s")
    return design(df.where(y.isNotNull()).withColumn("y", y), columns)


def _probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p_raw", vector_to_array("probability")[1])


def _average_precision(model, check: DataFrame) -> float:
    scored = _probability(model.transform(check)).select("y", F.col("p_raw").alias("p"))
    return metrics.ranking_metrics(scored, []).first()["pr_auc"] or 0.0


def _screened(fits: Sequence, check: DataFrame) -> int:
    """Position of the candidate with the best average precision on validation; the first of equal ones."""
    values = [_average_precision(fit(), check) for fit in fits]
    return values.index(max(values))


def fit_horizons(fit: Callable[[int], Fitted], horizons: Sequence[int], spark) -> dict[int, Fitted]:
    """``fit(horizon)`` of every horizon, side by side.

    A round of trees is a chain of short jobs, each waiting for the one before; other horizons use the cores meanwhile.  The fits share
    nothing but their input, so they are the same as one after the other.
    """
    with ThreadPool(max(len(horizons), 1)) as pool:
        return dict(zip(horizons, pool.map(inheritable_thread_target(spark)(fit), horizons, chunksize=1)))


def fit_boosted(
    train: DataFrame, val: DataFrame, horizon_s: int, rules: ModelRules = ModelRules(),
    columns: Sequence[str] = EXTENDED_PREDICTORS, wide: bool = False,
) -> Fitted:
    """Gradient boosted trees with class weights; rounds stop when validation loss stops falling.

    The ``wide`` family first screens its candidates.
    """
    both = weighted(_rows(train, horizon_s, columns)).withColumn("is_val", F.lit(False)).unionByName(
        _rows(val, horizon_s, columns).withColumns({"w": F.lit(1.0), "is_val": F.lit(True)})
    )
    both = store(both.select("features", "y", "w", "is_val"))
    check = both.where("is_val")
    stops = not check.isEmpty()
    if both.where("NOT is_val").isEmpty():
        return _nothing("wide_boosted" if wide else "boosted", columns)

    def fit(depth, leaf, step, rounds, inputs="all"):
        learner = GBTClassifier(
            featuresCol="features", labelCol="y", weightCol="w", validationIndicatorCol="is_val", stepSize=step,
            subsamplingRate=rules.subsample, seed=rules.seed, maxDepth=depth, minInstancesPerNode=leaf, maxIter=rounds,
            featureSubsetStrategy=inputs,
        )
        if not stops:
            learner.clear(learner.validationIndicatorCol)  # nothing to stop on
        return learner.fit(both)

    if not wide:
        model = fit(rules.boosted_depth, 1, rules.boosted_step, rules.boosted_rounds)
        return _calibrated("boosted", model, val, horizon_s, columns)
    share = str(rules.wide_inputs)
    options = rules.wide_candidates
    screen = [lambda o=o: fit(*o, rules.wide_screen_rounds, share) for o in options]
    best = _screened(screen, check) if stops else 0
    return _calibrated("wide_boosted", fit(*options[best], rules.wide_rounds, share), val, horizon_s, columns)


def fit_forest(
    train: DataFrame, val: DataFrame, horizon_s: int, rules: ModelRules = ModelRules(),
    columns: Sequence[str] = EXTENDED_PREDICTORS,
) -> Fitted:
    """Random forest; the candidate with the best average precision on validation is fitted in full."""
    rows = store(weighted(_rows(train, horizon_s, columns)).select("features", "y", "w"))

    def fit(depth, leaf, trees):
        return RandomForestClassifier(
            featuresCol="features", labelCol="y", weightCol="w", seed=rules.seed, maxDepth=depth, minInstancesPerNode=leaf, numTrees=trees
        ).fit(rows)

    if rows.isEmpty():
        return _nothing("forest", columns)
    check = store(_rows(val, horizon_s, columns).select("features", "y"))
    options = rules.forest_candidates
    best = _screened([lambda o=o: fit(*o, rules.forest_screen_trees) for o in options], check)
    return _calibrated("forest", fit(*options[best], rules.forest_trees), val, horizon_s, columns)


def _nothing(name: str, columns: Sequence[str]) -> Fitted:
    """What is known of a horizon without a labelled training row: no model, so null probabilities."""
    return Fitted(name, None, tuple(columns), 1.0, 0.0, 0.5)


def _calibrated(name, model, val: DataFrame, horizon_s: int, columns: Sequence[str]) -> Fitted:
    """Fit Platt scaling on validation, then tune the threshold on the calibrated values."""
    scored = store(_probability(model.transform(_rows(val, horizon_s, columns))).select("y", "p_raw"))
    one = VectorAssembler(inputCols=["p_raw"], outputCol="f").transform(scored)
    weight, bias, threshold = 1.0, 0.0, 0.5
    if scored.select("y").distinct().count() == 2:
        platt = LogisticRegression(featuresCol="f", labelCol="y").fit(one)
        weight, bias = float(platt.coefficients[0]), float(platt.intercept)
        table = metrics.threshold_table(
            scored.withColumn("p", metrics.calibrate("p_raw", weight, bias)), [], metrics.PROBABILITY_GRID
        )
        threshold = metrics.best_macro_f1(table).first()["threshold"]
    return Fitted(name, model, tuple(columns), weight, bias, threshold)


def score(df: DataFrame, fitted: Fitted, horizon_s: int) -> DataFrame:
    """Long predictions: identifiers, truth, raw and calibrated probability, decision, horizon."""
    if fitted.model is None:
        raw = df.withColumn("p_raw", F.lit(None).cast("double"))
    else:
        raw = _probability(fitted.model.transform(design(df, fitted.columns)))
    calibrated = metrics.calibrate("p_raw", fitted.weight, fitted.bias)
    return raw.select(
        "window_id", "user_id", "trajectory_id", "segment_id", "window_index", "start_us", "end_us",
        F.lit(fitted.name).alias("model"),
        F.lit(horizon_s).alias("horizon_s"),
        (F.col(f"target_{horizon_s}s") if f"target_{horizon_s}s" in df.columns else F.lit(None)).cast("double").alias("y_true"),
        F.col("p_raw").alias("raw_probability"),
        calibrated.alias("calibrated_probability"),
        (calibrated >= fitted.threshold).alias("y_pred"),
        F.lit(fitted.threshold).alias("threshold"),
    )


def importances(fitted: Fitted, spark, top: int = 10) -> DataFrame:
    """The ``top`` inputs by split gain; a missing flag counts for its input."""
    if fitted.model is None:
        return spark.createDataFrame([], "feature string, importance double")
    gain = fitted.model.featureImportances.toArray()
    n = len(fitted.columns)
    rows = [(c, float(gain[i] + gain[i + n])) for i, c in enumerate(fitted.columns)]
    return (
        spark.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )
