"""Risk dataset: outlier windows, horizon targets, prediction features, splits and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import BASELINE_FEATURES, RiskRules, SegmentRules
from tracewell.functions.quantiles import spread_sorted
from tracewell.functions.scan import max_before, ordered_scan, running_sum, time_chunk
from tracewell.operators.features import EXTENDED, calendar, melt
from tracewell.operators.profiles import empirical_baselines, population_baseline, sampled
from tracewell.session import store

BASE_COLUMNS = (
    "mean_speed_mps", "speed_std_dev", "path_distance_m", "straight_line_displacement_m",
    "tortuosity_index", "entropy_directional", "turn_frequency", "loop_metric",
    "pacing_tendency", "backtracking_tendency", "heading_variability", "point_count",
    "temporal_span_sec",
)
LAGGED = (
    "mean_speed_mps", "entropy_directional", "turn_frequency", "loop_metric", "pacing_tendency",
)
PREDICTORS = (
    *BASE_COLUMNS,
    *[f"delta_{c}" for c in LAGGED],
    *[f"{p}_{c}" for p in ("z", "ratio_to_med", "is_p95_exceeded") for c in BASELINE_FEATURES],
    "max_mad_z_score", "p95_exceedance_count",
    "hour_of_day", "day_of_week", "is_weekend", "trip_index", "is_cold_start",
)
EXTENDED_PREDICTORS = (*PREDICTORS, *EXTENDED, "sin_hour", "cos_hour", "sin_dow", "cos_dow")
IDS = (
    "window_id", "user_id", "trajectory_id", "segment_id", "segment_index", "window_index",
    "start_us", "end_us",
)
SEGMENT = ["user_id", "trajectory_id", "segment_index"]


# --- intervals ------------------------------------------------------------------------------


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str, end: str, chunk: Column
) -> DataFrame:
    """Union of overlapping or touching intervals per key."""
    keys = list(keys)
    seen = ordered_scan(df, keys, [start, end], chunk, {"_reach": max_before(F.col(end))})
    fresh = F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)).cast("int")
    islands = ordered_scan(
        seen.withColumn("_new", fresh), keys, [start, end], chunk, {"_island": running_sum(F.col("_new"))}
    )
    return islands.groupBy(*keys, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end)
    ).drop("_island")


def evidence_coverage(
    origins: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    horizon_s: int,
    rules: RiskRules = RiskRules(),
    contained_only: bool = False,
    max_interval_s: int = 120,
) -> DataFrame:
    """Share of ``[t_us, t_us + horizon]`` covered by intervals ``[s_us, e_us]``, and the gap test.

    ``origins`` has the keys, ``origin_id`` and ``t_us``; ``intervals`` has the keys, ``s_us``,
    ``e_us`` and ``is_outlier``.  Time bins turn the range join into an equality join; an origin
    meets the few intervals of its own horizon only.
    """
    keys, h = list(keys), horizon_s * 1_000_000
    reach = max(horizon_s, max_interval_s) * 1_000_000
    binned = intervals.withColumn("_bin", F.floor(F.col("s_us") / reach))
    asked = origins.select(*keys, "origin_id", "t_us").withColumn(
        "_bin",
        F.explode(F.sequence(F.floor((F.col("t_us") - reach) / reach), F.floor((F.col("t_us") + h) / reach))),
    )
    t, end = F.col("t_us"), F.col("t_us") + h
    if contained_only:
        inside = (F.col("s_us") >= t) & (F.col("e_us") <= end)
    else:
        inside = (F.col("s_us") < end) & (F.col("e_us") > t)
    clipped = (
        asked.join(binned, [*keys, "_bin"])
        .where(inside)
        .select(
            "origin_id", "t_us", "is_outlier",
            F.greatest("s_us", t).alias("s"), F.least("e_us", end).alias("e"),
        )
        .where("s < e")
    )
    w = Window.partitionBy("origin_id").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = clipped.withColumn("_reach", F.coalesce(before, t))
    gap = F.greatest(F.col("s") - F.col("_reach"), F.lit(0))
    limit = int(rules.max_coverage_gap_s * 1_000_000)
    met = parts.groupBy("origin_id").agg(
        (F.sum(F.greatest(F.col("e") - F.greatest("s", "_reach"), F.lit(0))) / 1e6).alias("evidence_s"),
        F.max(gap).alias("_gap"),
        F.max("e").alias("_last"),
        F.max("is_outlier").alias("has_outlier"),
    )
    out = origins.join(met, "origin_id", "left")
    ok = (F.col("_gap") <= limit) & (F.col("t_us") + h - F.col("_last") <= limit)
    return (
        out.withColumn("evidence_s", F.coalesce("evidence_s", F.lit(0.0)))
        .withColumns({
            "coverage_ratio": F.col("evidence_s") / float(horizon_s),
            "gap_valid": F.coalesce(ok, F.lit(False)),
        })
        .drop("_gap", "_last")
    )


# --- outliers -------------------------------------------------------------------------------


def wide_baselines(baselines: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """One row per key with ``b_<feature>`` structs, so windows join once instead of per feature."""
    stats = F.struct("median", "robust_scale", "p95")
    return baselines.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == f, stats)).alias(f"b_{f}") for f in BASELINE_FEATURES]
    )


def with_deviation(windows: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Deviation of every baseline feature and the outlier verdict; needs the ``b_`` columns."""
    eps, cols = rules.zero_mad_epsilon, {}
    for f in BASELINE_FEATURES:
        v, med = F.col(f).cast("double"), F.col(f"b_{f}.median")
        scale, p95 = F.col(f"b_{f}.robust_scale"), F.col(f"b_{f}.p95")
        usable = v.isNotNull() & med.isNotNull() & scale.isNotNull()
        diff = F.abs(v - med)
        flat = F.when(diff <= eps, 0.0).otherwise(rules.zero_mad_penalty)
        cols[f"z_{f}"] = F.when(
            usable, F.when(scale <= eps, flat).otherwise(diff / (scale + 1e-9))
        )
        cols[f"ratio_to_med_{f}"] = F.when(usable & (med > 0), v / (med + 1e-6))
        cols[f"is_p95_exceeded_{f}"] = F.when(
            usable, F.coalesce(v > p95, F.lit(False)).cast("double")
        )
    out = windows.withColumns(cols)
    z = [F.col(f"z_{f}") for f in BASELINE_FEATURES]
    hits = [F.coalesce(F.col(f"is_p95_exceeded_{f}"), F.lit(0.0)) for f in BASELINE_FEATURES]
    valid = sum((c.isNotNull().cast("int") for c in z), F.lit(0))
    out = out.withColumns({
        "valid_features": valid,
        "max_mad_z_score": F.greatest(*z),
        "p95_exceedance_count": F.when(valid > 0, sum(hits, F.lit(0.0))),
    })
    evaluable = F.col("valid_features") >= rules.min_valid_features
    return out.withColumns({
        "is_evaluable": evaluable,
        "is_outlier": evaluable
        & (
            (F.col("max_mad_z_score") >= rules.mad_multiplier)
            | (F.col("p95_exceedance_count") >= rules.min_p95_exceedances)
        ),
    })


def window_outliers(
    features: DataFrame, baselines: DataFrame, keys: Sequence[str] = ("user_id",), rules: RiskRules = RiskRules()
) -> DataFrame:
    """Windows compared with the baseline of their key; without keys the baseline is one row."""
    wide = wide_baselines(baselines, keys)
    joined = features.join(wide, list(keys), "left") if keys else features.crossJoin(F.broadcast(wide))
    return with_deviation(joined, rules)


# --- targets --------------------------------------------------------------------------------


def nominal_targets(
    judged: DataFrame, rules: RiskRules = RiskRules(), window_s: int = SegmentRules().window_s
) -> DataFrame:
    """``target_<h>s``: 1, 0, or null where not every slot of the horizon was evaluable.

    Windows are slots of one segment, one row per slot, so the look-ahead frame is short and the
    window over a segment is bounded by its length in time.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("window_index")
    out = {}
    for h in rules.horizons_s:
        slots = h // window_s
        ahead = w.rangeBetween(1, slots)
        seen = F.count_if("is_evaluable").over(ahead)
        hit = F.max(F.when(F.col("is_evaluable"), F.col("is_outlier"))).over(ahead)
        out[f"target_{h}s"] = F.when(seen == slots, hit.cast("double"))
    return judged.withColumns(out)


def actual_targets(judged: DataFrame, horizon_s: int, rules: RiskRules = RiskRules()) -> DataFrame:
    """Targets from the spans really observed instead of nominal slots."""
    usable = judged.where("is_evaluable AND is_kinematically_evaluable").select(
        *SEGMENT, F.col("start_us").alias("s_us"), F.col("end_us").alias("e_us"), "is_outlier"
    )
    origins = judged.select(*SEGMENT, F.col("window_id").alias("origin_id"), F.col("end_us").alias("t_us"))
    cover = evidence_coverage(origins, usable, SEGMENT, horizon_s, rules, contained_only=True)
    ends = judged.groupBy(*SEGMENT).agg(F.max("end_us").alias("_end"))
    ok = (
        (F.col("coverage_ratio") >= rules.coverage_ratio)
        & F.col("gap_valid")
        & (F.col("_end") >= F.col("t_us") + horizon_s * 1_000_000)
    )
    return cover.join(ends, SEGMENT).select(
        F.col("origin_id").alias("window_id"),
        F.when(ok, F.col("has_outlier").cast("double")).alias(f"target_{horizon_s}s"),
    )


def exclusion_table(targets: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Per horizon: origins, valid targets, excluded share and prevalence."""
    names = [f"target_{h}s" for h in rules.horizons_s]
    long = targets.select(*names).unpivot([], names, "target", "y")
    return long.groupBy("target").agg(
        F.count("*").alias("origins"),
        F.count("y").alias("valid"),
        (100.0 * (F.count("*") - F.count("y")) / F.count("*")).alias("excluded_pct"),
        F.avg("y").alias("prevalence"),
    )


# --- prediction features --------------------------------------------------------------------


def prediction_features(judged: DataFrame, extended: bool = False) -> DataFrame:
    """The 49 (or 72) inputs known at the end of a window.

    ``judged`` comes from :func:`with_deviation` and also has ``trip_index`` and ``is_cold_start``.
    Lags only reach the window just before in the same segment.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("window_index")
    before = F.lag(F.struct("window_index", *LAGGED)).over(w)
    rows = judged.withColumn("_prev", before)
    adjacent = F.col("_prev.window_index") == F.col("window_index") - 1
    columns = {
        f"delta_{c}": F.when(adjacent, F.col(c) - F.col(f"_prev.{c}")) for c in LAGGED
    }
    columns |= calendar()
    columns["trip_index"] = F.col("trip_index").cast("double")
    columns["is_cold_start"] = F.col("is_cold_start").cast("double")
    names = EXTENDED_PREDICTORS if extended else PREDICTORS
    kept = [c for c in judged.columns if c.startswith("target_")]
    out = rows.withColumns(columns)
    return out.select(*IDS, *[F.col(c).cast("double").alias(c) for c in names], *kept)


# --- splits ---------------------------------------------------------------------------------


def numbered_trips(features: DataFrame) -> DataFrame:
    """Trips of every user in order of their first window: ``trip_no`` from 1 and ``n_trips``."""
    starts = features.groupBy("user_id", "trajectory_id").agg(F.min("start_us").alias("start_us"))
    ordered = ordered_scan(
        starts,
        ["user_id"],
        ["start_us", "trajectory_id"],
        time_chunk("start_us", 30 * 86_400),
        {"trip_no": running_sum(F.lit(1))},
    )
    totals = starts.groupBy("user_id").agg(F.count("*").alias("n_trips"))
    return ordered.join(totals, "user_id")


def chronological_split(trips: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """70/15/15 by whole trips; users with fewer than three trips train only."""
    n, i = F.col("n_trips"), F.col("trip_no")
    train = F.greatest(F.floor(n * F.lit(rules.train_ratio)), F.lit(1))
    val = F.greatest(F.floor(n * F.lit(rules.val_ratio)), F.lit(1))
    full = train + val >= n
    a = F.when(full, F.greatest(n - 2, F.lit(1))).otherwise(train)
    b = a + F.when(full, 1).otherwise(val)
    part = F.when((n < 3) | (i <= a), "train").when(i <= b, "val").otherwise("test")
    return trips.withColumn("split", part)


def warmup_split(trips: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Seven warm-up trips, then 70/15/15 of the rest with at least one test trip."""
    rest = F.col("n_trips") - rules.warmup_trips
    i = F.col("trip_no") - rules.warmup_trips
    train = F.greatest(F.bround(rest * F.lit(rules.train_ratio)), F.lit(1.0))
    val = F.greatest(F.bround(rest * F.lit(rules.val_ratio)), F.lit(1.0))
    tight = (rest - train - val <= 0) & (train > 1)
    a = train - F.when(tight, 1).otherwise(0)
    part = (
        F.when((rest <= 0) | (i <= 0), "warmup")
        .when(i <= a, "train")
        .when(i <= a + val, "val")
        .otherwise("test")
    )
    return trips.withColumn("split", part)


def unseen_users(users: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Marks the 20 % of users with the smallest seeded hash as ``is_unseen``.

    The rank is counted in 65,536 slices of the hash, so no task sees all users.
    """
    digest = F.sha2(F.concat_ws(":", "user_id", F.lit(rules.seed)), 256)
    tagged = users.select("user_id").distinct().withColumns({"_h": digest, "_one": F.lit(1)})
    ranked = ordered_scan(
        tagged,
        ["_one"],
        ["_h"],
        F.conv(F.substring("_h", 1, 4), 16, 10).cast("bigint"),
        {"_rank": running_sum(F.lit(1))},
    )
    total = tagged.agg(F.count("*").alias("_n"))  # one row
    chosen = F.col("_rank") <= F.floor(F.col("_n") * F.lit(rules.unseen_user_ratio))
    return ranked.crossJoin(F.broadcast(total)).select("user_id", chosen.alias("is_unseen"))


def shared_trips(split: DataFrame) -> DataFrame:
    """Trips that appear in more than one part; empty when nothing leaks."""
    ids = {p: split.where(F.col("split") == p).select("trajectory_id") for p in ("train", "val", "test")}
    return (
        ids["train"].intersect(ids["val"])
        .unionByName(ids["train"].intersect(ids["test"]))
        .unionByName(ids["val"].intersect(ids["test"]))
        .distinct()
    )


# --- cohorts --------------------------------------------------------------------------------


#: Windows of a user that are held as one sorted array per feature.
HELD = 1000
#: A trip number above all others.
BEYOND = 1 << 62


def _baselines_before(asked: DataFrame, past: DataFrame, rules: RiskRules) -> DataFrame:
    """Baseline per asked ``(user_id, base_no)`` from the rows of ``past`` of the user's trips below ``base_no``.

    A user's values are shuffled and sorted once, and each asked trip picks from them what came before it.  A user of more than ``HELD``
    windows is joined with its asked trips instead, so that the work is spread over ``(user, trip)``.
    """
    keys = ["user_id", "base_no"]
    large = store(past.groupBy("user_id").agg(F.count("*").alias("_n")).where(F.col("_n") > HELD).select("user_id"))
    some = not large.isEmpty()
    few = past.join(F.broadcast(large), "user_id", "left_anti") if some else past
    long = melt(few, ["user_id", "trip_no"], BASELINE_FEATURES).where(F.col("value").isNotNull())
    value = F.struct((F.col("value") + 0.0).alias("v"), "trip_no")
    lists = long.groupBy("user_id", "feature").agg(F.sort_array(F.collect_list(value)).alias("_all"))
    earlier = F.filter("_all", lambda x: x["trip_no"] < F.col("base_no"))
    seen = asked.join(lists, "user_id").select(*keys, "feature", F.transform(earlier, lambda x: x["v"]).alias("_s"))
    out = sampled(spread_sorted(seen.where(F.size("_s") > 0), [*keys, "feature"]), keys, rules)
    if not some:
        return out
    many = asked.join(past.join(F.broadcast(large), "user_id", "left_semi"), "user_id").where(F.col("trip_no") < F.col("base_no"))
    return out.unionByName(empirical_baselines(many.drop("trip_no"), keys, rules))


def past_baselines(windows: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Baseline per ``(user_id, base_no)`` from the user's trips before trip ``base_no``, for trips beyond the warm-up."""
    past = windows.select("user_id", "trip_no", *BASELINE_FEATURES)
    asked = windows.where(F.col("trip_no") > rules.warmup_trips).select("user_id", F.col("trip_no").alias("base_no")).distinct()
    return _baselines_before(asked, past, rules)


def expanding_baselines(windows: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Baseline per ``(user_id, base_no)`` from the learning trips numbered below ``base_no``.

    Train trips see all earlier trips; ``base_no`` 0 is the frozen baseline used for validation
    and test.  An exact expanding median has no incremental form, so each train trip reads its
    user's past; the work is spread over ``(user, trip)``, not over users.
    """
    past = windows.where("split IN ('warmup', 'train')").select("user_id", "trip_no", *BASELINE_FEATURES)
    asked = windows.where("split = 'train'").select("user_id", F.col("trip_no").alias("base_no")).distinct()
    # The frozen baseline is that of a trip beyond all others.
    frozen = past.select("user_id").distinct().withColumn("base_no", F.lit(BEYOND).cast("bigint"))
    number = F.when(F.col("base_no") == BEYOND, 0).otherwise(F.col("base_no")).cast("bigint")
    return _baselines_before(asked.unionByName(frozen), past, rules).withColumn("base_no", number)


def held_out(features: DataFrame, rules: RiskRules = RiskRules()) -> tuple[DataFrame, DataFrame]:
    """Rows of known users and rows of unseen ones; nothing is ever learned from the latter."""
    marked = features.join(unseen_users(features.select("user_id"), rules), "user_id")
    return tuple(marked.where(F.col("is_unseen") == flag).select(*features.columns) for flag in (False, True))


def split_windows(known: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Windows of known users with ``trip_no`` and ``split`` (warmup, train, val, test)."""
    parts = warmup_split(numbered_trips(known), rules).select("user_id", "trajectory_id", "trip_no", "split")
    return known.join(parts, ["user_id", "trajectory_id"])


def population_prior(known: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Population baseline over the warm-up and training trips of known users."""
    return population_baseline(split_windows(known, rules).where("split IN ('warmup', 'train')"), rules)


def known_cohort(features: DataFrame, rules: RiskRules = RiskRules(), extended: bool = False) -> DataFrame:
    """Prediction rows of the known users with ``split`` train, val or test; past-only baselines."""
    windows = store(split_windows(held_out(features, rules)[0], rules))
    base = wide_baselines(expanding_baselines(windows, rules), ("user_id", "base_no"))
    asked = windows.where("split <> 'warmup'").withColumn(
        "base_no", F.when(F.col("split") == "train", F.col("trip_no")).otherwise(0)
    )
    judged = with_deviation(asked.join(base, ["user_id", "base_no"], "left"), rules).withColumns(
        {"trip_index": F.col("trip_no"), "is_cold_start": F.lit(0)}
    )
    rows = store(nominal_targets(judged, rules))
    out = prediction_features(rows, extended)
    return out.join(rows.select("window_id", "split"), "window_id")


def unseen_cohorts(features: DataFrame, rules: RiskRules = RiskRules(), extended: bool = False) -> DataFrame:
    """Rows of the unseen users: ``zero_shot`` against the known users' population, ``adapted`` after seven trips."""
    known, unseen = held_out(features, rules)
    population = population_prior(known, rules)
    trips = numbered_trips(unseen).select("user_id", "trajectory_id", "trip_no", "n_trips")
    windows = store(unseen.join(trips, ["user_id", "trajectory_id"]))
    cold = window_outliers(windows, population, (), rules).withColumns(
        {"cohort": F.lit("zero_shot"), "is_cold_start": F.lit(1)}
    )
    warm = windows.where(F.col("n_trips") > rules.warmup_trips)
    own = empirical_baselines(
        warm.where(F.col("trip_no") <= rules.warmup_trips), ("user_id",), rules
    )
    adapted = window_outliers(
        warm.where(F.col("trip_no") > rules.warmup_trips), own, ("user_id",), rules
    ).withColumns({"cohort": F.lit("adapted"), "is_cold_start": F.lit(0)})
    outs = []
    for judged in (cold, adapted):
        rows = nominal_targets(judged.withColumn("trip_index", F.col("trip_no")), rules)
        rows = store(rows)
        outs.append(
            prediction_features(rows, extended).join(rows.select("window_id", "cohort"), "window_id")
        )
    return outs[0].unionByName(outs[1])
