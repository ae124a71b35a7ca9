"""Evaluation of binary scores from counts: no row is repeated per threshold.

``scored`` has the key columns, ``y`` (0 or 1) and ``p``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scan import ordered_scan, running_sum
from tracewell.session import store


def grid(low: float, high: float, steps: int) -> list[float]:
    """Evenly spaced candidates including both ends."""
    step = (high - low) / (steps - 1)
    return [low + i * step for i in range(steps - 1)] + [high]


MAD_GRID = grid(1.0, 5.0, 41)
COUNT_GRID = [1.0, 2.0, 3.0, 4.0]
PROBABILITY_GRID = grid(0.1, 0.9, 81)
RECALL_GRID = grid(0.40, 0.98, 59)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """All ratio metrics of a confusion table; undefined ratios are zero."""
    n = tp + fp + fn + tn
    f1_pos, f1_neg = _ratio(2.0 * tp, 2 * tp + fp + fn), _ratio(2.0 * tn, 2 * tn + fp + fn)
    has_pos, has_neg = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    recall, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return {
        "n_samples": n,
        "prevalence": _ratio(tp + fn, n),
        "precision_pos": _ratio(tp, tp + fp),
        "recall_pos": recall,
        "f1_pos": f1_pos,
        "precision_neg": _ratio(tn, tn + fn),
        "recall_neg": spec,
        "f1_neg": f1_neg,
        # The average is over classes that occur in truth or prediction.
        "macro_f1": _ratio(f1_pos * has_pos + f1_neg * has_neg, has_pos + has_neg),
        "fpr": _ratio(fp, fp + tn),
        "specificity": spec,
        "balanced_accuracy": (recall + spec) / 2,
        "accuracy": _ratio(tp + tn, n),
    }


def confusion_counts(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts from columns ``y`` and ``yhat``."""
    y, h = F.col("y") == 1, F.col("yhat") == 1
    return predicted.groupBy(*keys).agg(
        F.count_if(y & h).alias("tp"),
        F.count_if(~y & h).alias("fp"),
        F.count_if(y & ~h).alias("fn"),
        F.count_if(~y & ~h).alias("tn"),
    )


def binary_metrics(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return with_rates(confusion_counts(predicted, keys))


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def score_curve(scored: DataFrame, keys: Sequence[str], slices: int = 4096) -> DataFrame:
    """Cumulative true and false positives per distinct score, from the highest score down.

    Scores are summed per value first; the running totals are taken inside slices of the score
    range, so a curve of any length is spread over tasks.
    """
    keys = list(keys)
    counts = scored.groupBy(*keys, "p").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    tagged = counts.withColumns({"_down": -F.col("p"), "_one": F.lit(1)})
    lanes = {"tp": running_sum(F.col("pos")), "fp": running_sum(F.col("neg"))}
    chunk = F.floor(F.col("_down") * slices).cast("bigint")
    return ordered_scan(tagged, [*keys, "_one"], ["_down"], chunk, lanes).drop("_down", "_one")


def class_totals(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg")
    )


def ranking_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC-AUC (ties shared), average precision and Brier score; null with one class only."""
    keys = list(keys)
    scored = store(scored.select(*keys, F.col("y").cast("bigint").alias("y"), "p"))
    curve = score_curve(scored, keys)
    area = curve.groupBy(*keys).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("_auc"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
    )
    brier = scored.groupBy(*keys).agg(
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier_score")
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    joined = area.join(brier, keys) if keys else area.crossJoin(brier)
    return joined.select(
        *keys,
        F.when(both, F.col("_auc") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("_p")).alias("pr_auc"),
        "brier_score",
    )


def curve_points(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall and false-positive rate at every distinct score."""
    keys = list(keys)
    totals = class_totals(scored, keys)
    curve = score_curve(scored.withColumn("y", F.col("y").cast("bigint")), keys)
    joined = curve.join(totals, keys) if keys else curve.crossJoin(F.broadcast(totals))
    return joined.select(
        *keys,
        F.col("p").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
        _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
    )


def threshold_table(
    scored: DataFrame, keys: Sequence[str], candidates: Sequence[float], score: str = "p"
) -> DataFrame:
    """Confusion counts and rates at every candidate threshold.

    Each row is counted once in the interval between two candidates; the table is summed from
    those counts.
    """
    keys = list(keys)
    cuts = F.array(*[F.lit(float(c)) for c in candidates])
    passed = _passed(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), candidates, cuts)
    hist = scored.groupBy(*keys, passed.alias("_passed")).agg(
        F.sum(F.col("y").cast("bigint")).alias("_pos"), F.count("*").alias("_all")
    )
    each = hist.select(
        "*", F.posexplode(cuts).alias("_i", "threshold")
    )  # at most len(candidates)^2 rows per key
    hit = F.col("_passed") > F.col("_i")
    neg = F.col("_all") - F.col("_pos")
    zero = F.lit(0)
    counts = each.groupBy(*keys, "threshold").agg(
        F.sum(F.when(hit, F.col("_pos")).otherwise(zero)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(zero)).alias("fp"),
        F.sum(F.when(~hit, F.col("_pos")).otherwise(zero)).alias("fn"),
        F.sum(F.when(~hit, neg).otherwise(zero)).alias("tn"),
    )
    return with_rates(counts)


def _passed(value: Column, candidates: Sequence[float], cuts: Column) -> Column:
    """How many ascending, evenly spaced candidates are not above the value.

    The position is computed and then checked against the exact neighbours, so rounding of the
    spacing cannot move a value over a threshold.
    """
    n, low, high = len(candidates), float(candidates[0]), float(candidates[-1])
    step = (high - low) / (n - 1)
    at = F.floor((value - low) / step).cast("int")
    at = F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))
    upper = F.get(cuts, F.least(at + 1, F.lit(n - 1)))
    return (
        at
        + (value >= F.get(cuts, at)).cast("int")
        + ((at < n - 1) & (value >= upper)).cast("int")
    )


def best_macro_f1(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold with the highest macro-F1; the lowest threshold wins a tie."""
    best = F.max(F.struct(F.round("macro_f1", 12).alias("f1"), (-F.col("threshold")).alias("t")))
    return table.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, (-F.col("_b.t")).alias("threshold"), F.col("_b.f1").alias("macro_f1")
    )


def threshold_under_recall_floor(table: DataFrame, keys: Sequence[str], floor: Column) -> DataFrame:
    """Highest specificity (then recall, then lowest threshold) among candidates that keep the
    recall floor; without any, the candidate with the highest recall."""
    ok = F.col("recall_pos") >= floor
    low = -F.col("threshold")
    fields = ("specificity", "recall_pos")
    good = F.struct(*[F.round(c, 12).alias(c) for c in fields], low.alias("t"))
    fallback = F.struct(F.round("recall_pos", 12).alias("recall_pos"), low.alias("t"))
    picked = table.groupBy(*keys).agg(
        F.max(F.when(ok, good)).alias("_g"), F.max(fallback).alias("_f")
    )
    return picked.select(
        *keys,
        F.col("_g").isNotNull().alias("floor_met"),
        (-F.coalesce("_g.t", "_f.t")).alias("threshold"),
    )


DELTA_METRICS = (
    "fpr", "specificity", "recall_pos", "precision_pos", "balanced_accuracy", "macro_f1", "accuracy",
)


def metric_deltas(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change of counts and rates between two operating points."""
    names = ("fp", "fn", *DELTA_METRICS)
    old = before.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in names])
    return after.join(old, list(keys)).select(
        *keys, *[(F.col(c) - F.col(f"_old_{c}")).alias(f"delta_{c}") for c in names]
    )


def winners(table: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """Best model per horizon and metric.  ``metrics`` maps a name to True where larger is better.

    ``table`` has one row per (model, horizon_s); the ranking window is that small.
    """
    long = table.unpivot(["model", "horizon_s"], list(metrics), "metric", "value")
    sign = F.when(F.col("metric").isin([m for m, up in metrics.items() if up]), -1).otherwise(1)
    w = Window.partitionBy("horizon_s", "metric").orderBy(sign * F.col("value"), "model")
    return long.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mad_probability(threshold: Column | float, score: str = "max_mad_z_score") -> Column:
    """Sigmoid of the deviation score centred on its tuned threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return 1 / (1 + F.exp(-(F.coalesce(F.col(score), F.lit(0.0)) - t)))


def exceedance_probability(n_features: int = 8, score: str = "p95_exceedance_count") -> Column:
    """Share of features above their 95th percentile."""
    return F.least(F.coalesce(F.col(score), F.lit(0.0)) / n_features, F.lit(1.0))


def calibrate(p: Column | str, weight: float, bias: float) -> Column:
    """Platt scaling: sigmoid(weight * p + bias)."""
    p = F.col(p) if isinstance(p, str) else p
    return 1 / (1 + F.exp(-(F.lit(float(weight)) * p + F.lit(float(bias)))))
