"""Movement pattern of a window: ordered rules, four confidences, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import BehaviorRules
from tracewell.functions import geo
from tracewell.functions.quantiles import percentiles
from tracewell.operators.features import melt

CLASSES = ("NORMAL", "PACING", "LAPPING", "RANDOM_DRIFT", "INSUFFICIENT_EVIDENCE")
METRICS = (
    "path_distance_m", "straight_line_displacement_m", "path_closure_ratio", "loop_metric",
    "pacing_tendency", "heading_variability", "entropy_directional", "turn_frequency",
    "mean_speed_mps",
)


def _z(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def classify(features: DataFrame, rules: BehaviorRules = BehaviorRules()) -> DataFrame:
    """Add ``behavior_class`` and the four confidences; a pure projection."""
    path, diag = F.col("path_distance_m"), F.col("bbox_diagonal_m")
    w, h = F.col("bbox_width_m"), F.col("bbox_height_m")
    closure, back, loop = _z("path_closure_ratio"), _z("backtracking_tendency"), _z("loop_metric")
    entropy, variability = _z("entropy_directional"), _z("heading_variability")
    frequency, turn = _z("turn_frequency"), _z("heading_change_mean")
    aspect = F.least(w, h) / F.greatest(w, h, F.lit(1.0))
    expansion = path / F.greatest(diag, F.lit(1.0))
    thin = (
        ~F.col("is_kinematically_evaluable")
        | (path < rules.min_path_m)
        | (diag < rules.min_extent_m)
        | F.col("has_extreme_kinematic_transition")
        | F.col("path_closure_ratio").isNull()
    )
    pacing = (
        (closure >= rules.pacing_closure)
        & (expansion >= rules.pacing_expansion)
        & (back >= rules.pacing_backtracking)
        & (entropy <= rules.pacing_max_entropy)
    )
    lapping = (
        (closure >= rules.lapping_closure)
        & (loop >= rules.lapping_loop)
        & (aspect >= rules.lapping_aspect)
        & (back <= rules.lapping_max_backtracking)
        & (turn <= rules.lapping_max_turn)
    )
    drift = (
        (entropy >= rules.drift_entropy)
        & (variability >= rules.drift_heading_variability)
        & ((frequency >= rules.drift_turn_frequency) | (turn >= rules.drift_turn))
        & (loop <= rules.drift_max_loop)
    )
    label = (
        F.when(thin, "INSUFFICIENT_EVIDENCE")
        .when(pacing, "PACING")
        .when(lapping, "LAPPING")
        .when(drift, "RANDOM_DRIFT")
        .otherwise("NORMAL")
    )
    unit = geo.unit_interval
    ratio = F.col("straight_line_displacement_m") / F.greatest(path, F.lit(1.0))
    scores = {
        "normal_confidence": 0.6 * ratio + 0.4 * (1 - variability),
        "pacing_confidence": 0.4 * closure
        + 0.3 * unit((expansion - 1) / 3.0)
        + 0.3 * unit(back / 0.1),
        "lapping_confidence": 0.5 * loop + 0.3 * closure + 0.2 * unit(1 - back / 0.1),
        "random_drift_confidence": 0.4 * entropy + 0.3 * variability + 0.3 * unit(turn / 90.0),
    }
    out = features.withColumn("behavior_class", label)
    shaky = F.col("behavior_class") == "INSUFFICIENT_EVIDENCE"
    return out.withColumns(
        {n: F.when(shaky, 0.0).otherwise(F.round(unit(s), 4)) for n, s in scores.items()}
    )


def class_confidence() -> Column:
    """Confidence of the assigned class (zero where evidence is insufficient)."""
    c = F.col("behavior_class")
    return (
        F.when(c == "NORMAL", F.col("normal_confidence"))
        .when(c == "PACING", F.col("pacing_confidence"))
        .when(c == "LAPPING", F.col("lapping_confidence"))
        .when(c == "RANDOM_DRIFT", F.col("random_drift_confidence"))
        .otherwise(0.0)
    )


def class_shares(classified: DataFrame) -> DataFrame:
    counts = classified.groupBy("behavior_class").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # at most five rows
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def class_metrics(classified: DataFrame) -> DataFrame:
    """Mean, median and quartiles of nine metrics per class."""
    long = melt(classified, ["behavior_class"], METRICS).where("value is not null")
    keys = ["behavior_class", "feature"]
    mean = long.groupBy(*keys).agg(F.avg("value").alias("mean"))
    cut = percentiles(long, keys, "value", [0.25, 0.5, 0.75]).select(
        *keys,
        "n",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("p75"),
    )
    return mean.join(cut, keys)


def confusion(df: DataFrame, truth: str = "true_class", guess: str = "behavior_class") -> DataFrame:
    return df.groupBy(F.col(truth).alias("true_class"), F.col(guess).alias("predicted_class")).agg(
        F.count("*").alias("n")
    )


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class plus the macro average, from a confusion table."""
    labels = matrix.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    truth = matrix.groupBy(F.col("true_class").alias("class")).agg(F.sum("n").alias("support"))
    guess = matrix.groupBy(F.col("predicted_class").alias("class")).agg(F.sum("n").alias("hits"))
    right = matrix.where("true_class = predicted_class").select(
        F.col("true_class").alias("class"), F.col("n").alias("tp")
    )
    t = (
        labels.join(truth, "class", "left")
        .join(guess, "class", "left")
        .join(right, "class", "left")
        .fillna(0)
    )
    prec = F.when(F.col("hits") > 0, F.col("tp") / F.col("hits")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    t = t.select("class", "support", prec.alias("precision"), rec.alias("recall")).withColumn(
        "f1",
        F.when(
            F.col("precision") + F.col("recall") > 0,
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
        ).otherwise(0.0),
    )
    macro = t.agg(
        F.lit("macro avg").alias("class"),
        F.sum("support").alias("support"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
    )
    return t.unionByName(macro)


def first_mismatches(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` misclassified windows in id order (a report)."""
    return (
        df.where(F.col("true_class") != F.col("behavior_class"))
        .select("window_id", "true_class", "behavior_class", *METRICS[:4], "entropy_directional")
        .orderBy("window_id")
        .limit(n)
    )


def regime_report(df: DataFrame) -> DataFrame:
    """Recall of RANDOM_DRIFT and median descriptors per ``regime``."""
    counts = df.groupBy("regime").agg(
        F.count("*").alias("total_windows"),
        F.count_if(F.col("behavior_class") == "RANDOM_DRIFT").alias("detected_random_drift"),
        F.count_if(F.col("behavior_class") == "NORMAL").alias("classified_normal"),
    )
    columns = [
        "entropy_directional", "heading_variability", "turn_frequency",
        "straight_line_displacement_m", "path_distance_m",
    ]
    mids = percentiles(melt(df, ["regime"], columns), ["regime", "feature"], "value", [0.5])
    wide = mids.groupBy("regime").agg(
        *[
            F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"median_{c}")
            for c in columns
        ]
    )
    recall = F.round(F.col("detected_random_drift") / F.col("total_windows"), 3)
    return counts.join(wide, "regime", "left").withColumn("recall", recall)
