"""Queries over the risk dataset, its splits, evaluation and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.config import BASELINE_FEATURES, RiskRules
from tracewell.functions.scan import time_chunk
from tracewell.operators import features as feature_ops
from tracewell.operators import metrics, models, profiles, risk
from tracewell.plans import adapter
from tracewell.plans.profile_queries import SPREAD
from tracewell.plans.registry import query, rnd, rounded
from tracewell.plans.sqltext import BASE, feat, q
from tracewell.plans.window_queries import feature_table
from tracewell.session import store

# --- intervals ------------------------------------------------------------------------------

INTERVALS = BASE + """,
iv AS (SELECT uid, us AS s, us + (k * 600 + 60) * 1000000 AS e FROM base)"""


@query(
    "rsk1_interval_union",
    q(INTERVALS, """, m AS (SELECT *, max(e) OVER (PARTITION BY uid ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
      i AS (SELECT *, sum(CASE WHEN s > reach OR reach IS NULL THEN 1 ELSE 0 END) OVER (
        PARTITION BY uid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
      SELECT uid, min(s) AS s, max(e) AS e FROM i GROUP BY uid, island""").replace(")\n, m AS", "),\nm AS"),
)
def interval_union(spark, sf):
    iv = adapter.base(spark, sf).select(
        "uid", F.col("us").alias("s"), F.expr("us + (k * 600 + 60) * 1000000").alias("e")
    )
    return risk.merge_intervals(iv, ["uid"], "s", "e", time_chunk("s", 86_400))


COVER = feat() + """,
o AS (SELECT window_id AS origin_id, trajectory_id, segment_index, end_us AS t FROM feat),
c AS (SELECT o.origin_id, o.t, greatest(f.start_us, o.t) AS s, least(f.end_us, o.t+360000000) AS e
  FROM o JOIN feat f USING (trajectory_id, segment_index)
  WHERE f.start_us < o.t+360000000 AND f.end_us > o.t),
c2 AS (SELECT *, coalesce(max(e) OVER (PARTITION BY origin_id ORDER BY s, e
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t) AS reach FROM c WHERE s < e),
c3 AS (SELECT origin_id, sum(greatest(e-greatest(s, reach), 0))/1e6 AS evidence_s,
  max(greatest(s-reach, 0)) AS gap, max(e) AS last, min(t) AS t FROM c2 GROUP BY 1)"""


@query(
    "rsk2_evidence_coverage",
    q(COVER, """SELECT origin_id, round(coalesce(evidence_s, 0.0), 6) AS evidence_s,
      round(coalesce(evidence_s, 0.0)/360.0, 6) AS coverage_ratio,
      coalesce(gap <= 180000000 AND c3.t+360000000-last <= 180000000, false) AS gap_valid
      FROM o LEFT JOIN c3 USING (origin_id)"""),
)
def coverage(spark, sf):
    f = store(feature_table(spark, sf).select("window_id", *risk.SEGMENT, "start_us", "end_us"))
    origins = f.select(*risk.SEGMENT, F.col("window_id").alias("origin_id"), F.col("end_us").alias("t_us"))
    iv = f.select(
        *risk.SEGMENT, F.col("start_us").alias("s_us"), F.col("end_us").alias("e_us"), F.lit(False).alias("is_outlier")
    )
    out = risk.evidence_coverage(origins, iv, risk.SEGMENT, 360)
    return rounded(out.select("origin_id", "evidence_s", "coverage_ratio", "gap_valid"), 6, ["evidence_s", "coverage_ratio"])


# --- outliers and targets -------------------------------------------------------------------

LONGW = "longw AS (" + " UNION ALL ".join(
    f"SELECT window_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM win_in" for c in BASELINE_FEATURES
) + ")"


def judged_sql(ctes: str, windows: str, on: str) -> str:
    """Outlier verdicts: ``windows`` feeds win_in (with join keys), ``on`` joins win_in to bl."""
    return ctes + f""",
win_in AS ({windows}),
{LONGW},
dz AS (SELECT w.window_id, l.feature, l.v, b.median, b.p95,
    CASE WHEN b.robust_scale <= 1e-6 THEN CASE WHEN abs(l.v-b.median) <= 1e-6 THEN 0.0 ELSE 10.0 END
      ELSE abs(l.v-b.median)/(b.robust_scale+1e-9) END AS z,
    CASE WHEN b.median > 0 THEN l.v/(b.median+1e-6) END AS ratio,
    CASE WHEN coalesce(l.v > b.p95, false) THEN 1.0 ELSE 0.0 END AS hit
  FROM win_in w JOIN longw l USING (window_id) JOIN bl b ON {on} AND b.feature = l.feature
  WHERE l.v IS NOT NULL AND b.median IS NOT NULL AND b.robust_scale IS NOT NULL),
dw AS (SELECT window_id, count(*) AS valid_features, max(z) AS max_mad_z_score, sum(hit) AS p95_exceedance_count
  FROM dz GROUP BY 1),
judged AS (SELECT w.*, coalesce(valid_features, 0) AS valid_features, max_mad_z_score, p95_exceedance_count,
    coalesce(valid_features, 0) >= 3 AS is_evaluable,
    coalesce(valid_features, 0) >= 3 AND (max_mad_z_score >= 3 OR p95_exceedance_count >= 2) AS is_outlier
  FROM win_in w LEFT JOIN dw USING (window_id)),
tg AS (SELECT *, """ + ", ".join(
        f"""CASE WHEN count(*) FILTER (WHERE is_evaluable) OVER h{h} = {h // 120} THEN
      max(CASE WHEN is_evaluable THEN CASE WHEN is_outlier THEN 1.0 ELSE 0.0 END END) OVER h{h} END AS target_{h}s"""
        for h in (120, 360, 600, 840)
    ) + " FROM judged WINDOW " + ", ".join(
        f"""h{h} AS (PARTITION BY trajectory_id, segment_index ORDER BY window_index
      RANGE BETWEEN 1 FOLLOWING AND {h // 120} FOLLOWING)""" for h in (120, 360, 600, 840)
    ) + ")"


OWN = judged_sql(
    SPREAD + """,
bl AS (SELECT user_id, feature, CASE WHEN n >= 10 THEN median END AS median,
  CASE WHEN n >= 10 THEN robust_scale END AS robust_scale, CASE WHEN n >= 10 THEN p95 END AS p95 FROM sp)""",
    "SELECT * FROM feat", "b.user_id = w.user_id",
)


def judged(spark, sf, squeeze=1000):
    f = store(feature_table(spark, sf, squeeze))
    return risk.window_outliers(f, profiles.empirical_baselines(f))


@query(
    "rsk3_window_outliers",
    q(OWN, """SELECT window_id, valid_features, round(max_mad_z_score, 4) AS max_mad_z_score, p95_exceedance_count,
      is_evaluable, is_outlier FROM judged"""),
)
def window_outliers(spark, sf):
    j = judged(spark, sf).select(
        "window_id", F.col("valid_features").cast("bigint").alias("valid_features"), "max_mad_z_score",
        "p95_exceedance_count", "is_evaluable", "is_outlier",
    )
    return rounded(j, 4, ["max_mad_z_score"])


TARGETS = ["target_120s", "target_360s", "target_600s", "target_840s"]


@query("rsk4_nominal_targets", q(OWN, f"SELECT window_id, {', '.join(TARGETS)} FROM tg"))
def nominal_targets(spark, sf):
    return risk.nominal_targets(judged(spark, sf)).select("window_id", *TARGETS)


@query("rsk4_actual_targets", q(OWN, """, o AS (SELECT window_id AS origin_id, trajectory_id, segment_index, end_us AS t FROM judged),
  c AS (SELECT o.origin_id, o.t, f.start_us AS s, f.end_us AS e, f.is_outlier FROM o JOIN judged f USING (trajectory_id, segment_index)
    WHERE f.start_us >= o.t AND f.end_us <= o.t+120000000 AND f.is_evaluable AND f.is_kinematically_evaluable),
  a AS (SELECT origin_id, sum(e-s)/1e6 AS ev, max(CASE WHEN is_outlier THEN 1.0 ELSE 0.0 END) AS y FROM c GROUP BY 1)
  SELECT origin_id AS window_id, CASE WHEN ev >= 120 THEN y END AS target_120s FROM o LEFT JOIN a USING (origin_id)""").replace(")\n, o AS", "),\no AS"))
def actual_targets(spark, sf):
    return risk.actual_targets(store(judged(spark, sf)), 120)


@query(
    "met9_exclusion_table",
    q(OWN, " UNION ALL ".join(
        f"""SELECT '{t}' AS target, count(*) AS origins, count({t}) AS valid,
        round(100.0*(count(*)-count({t}))/count(*), 6) AS excluded_pct, round(avg({t}), 6) AS prevalence FROM tg"""
        for t in TARGETS
    )),
)
def exclusions(spark, sf):
    t = risk.exclusion_table(risk.nominal_targets(judged(spark, sf)))
    return rounded(t, 6, ["excluded_pct", "prevalence"])


def pred_sql(src: str) -> str:
    z = ", ".join(
        f"max(CASE WHEN feature = '{f}' THEN z END) AS z_{f}, max(CASE WHEN feature = '{f}' THEN ratio END) AS ratio_to_med_{f},"
        f" max(CASE WHEN feature = '{f}' THEN hit END) AS is_p95_exceeded_{f}" for f in BASELINE_FEATURES
    )
    lag = ", ".join(
        f"CASE WHEN lag(window_index) OVER s = window_index-1 THEN {c} - lag({c}) OVER s END AS delta_{c}"
        for c in risk.LAGGED
    )
    return f""",
zz AS (SELECT window_id, {z} FROM dz GROUP BY 1),
pr AS (SELECT t.* EXCLUDE (point_count), CAST(point_count AS DOUBLE) AS point_count,
    {', '.join(f'zz.{p}_{f}' for f in BASELINE_FEATURES for p in ('z', 'ratio_to_med', 'is_p95_exceeded'))}, {lag},
    CAST(start_us // 3600000000 % 24 AS DOUBLE) AS hour_of_day, CAST((start_us // 86400000000 + 3) % 7 AS DOUBLE) AS day_of_week,
    CASE WHEN (start_us // 86400000000 + 3) % 7 >= 5 THEN 1.0 ELSE 0.0 END AS is_weekend
  FROM {src} t LEFT JOIN zz USING (window_id)
  WINDOW s AS (PARTITION BY trajectory_id, segment_index ORDER BY window_index))"""


PRED_COLUMNS = [c for c in risk.PREDICTORS]


def with_context(spark, sf):
    j = judged(spark, sf)
    return j.withColumns({"trip_index": F.lit(1), "is_cold_start": F.lit(0)})


@query(
    "rsk5_prediction_features",
    q(OWN + pred_sql("judged"), f"""SELECT window_id, {rnd([c for c in PRED_COLUMNS if c not in ('trip_index', 'is_cold_start')], 3)},
      1.0 AS trip_index, 0.0 AS is_cold_start FROM pr"""),
)
def prediction_features(spark, sf):
    p = risk.prediction_features(with_context(spark, sf)).select("window_id", *PRED_COLUMNS)
    return rounded(p, 3, PRED_COLUMNS)


EXT = list(feature_ops.EXTENDED)


@query(
    "rsk6_extended_features",
    q(OWN + pred_sql("judged"), f"""SELECT window_id, {rnd(['max_mad_z_score', *EXT], 3)},
      round(sin(2*pi()*hour_of_day/24), 6) + 0.0 AS sin_hour, round(cos(2*pi()*day_of_week/7), 6) + 0.0 AS cos_dow FROM pr"""),
)
def extended_features(spark, sf):
    p = risk.prediction_features(with_context(spark, sf), extended=True)
    p = p.select("window_id", "max_mad_z_score", *EXT, "sin_hour", "cos_dow")
    return rounded(rounded(p, 3, ["max_mad_z_score", *EXT]), 6, ["sin_hour", "cos_dow"])


# --- splits and cohorts ---------------------------------------------------------------------

NUMBERED = feat() + """,
tn AS (SELECT user_id, trajectory_id, row_number() OVER (PARTITION BY user_id ORDER BY min(start_us), trajectory_id) AS trip_no,
  count(*) OVER (PARTITION BY user_id) AS n_trips FROM feat GROUP BY 1, 2)"""


def numbered(spark, sf):
    return risk.numbered_trips(store(feature_table(spark, sf).select("user_id", "trajectory_id", "start_us")))


@query(
    "rsk7_chronological_split",
    q(NUMBERED, """SELECT trajectory_id, trip_no, CASE WHEN n_trips < 3 OR trip_no <= a THEN 'train'
      WHEN trip_no <= a + v THEN 'val' ELSE 'test' END AS split FROM (
      SELECT *, CASE WHEN t0 + v0 >= n_trips THEN greatest(n_trips-2, 1) ELSE t0 END AS a,
        CASE WHEN t0 + v0 >= n_trips THEN 1 ELSE v0 END AS v FROM (
      SELECT *, greatest(CAST(floor(n_trips*0.7::DOUBLE) AS BIGINT), 1) AS t0,
        greatest(CAST(floor(n_trips*0.15::DOUBLE) AS BIGINT), 1) AS v0 FROM tn))"""),
)
def chronological(spark, sf):
    return risk.chronological_split(numbered(spark, sf)).select("trajectory_id", "trip_no", "split")


WARM = NUMBERED + """,
ws AS (SELECT *, CASE WHEN rest <= 0 OR i <= 0 THEN 'warmup' WHEN i <= a THEN 'train' WHEN i <= a+v THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, t - CASE WHEN rest-t-v <= 0 AND t > 1 THEN 1 ELSE 0 END AS a FROM (
  SELECT *, n_trips-7 AS rest, trip_no-7 AS i, greatest(round_even((n_trips-7)*0.7::DOUBLE, 0), 1) AS t,
    greatest(round_even((n_trips-7)*0.15::DOUBLE, 0), 1) AS v FROM tn)))"""


@query("rsk8_warmup_split", q(WARM, "SELECT trajectory_id, trip_no, split FROM ws"))
def warmup(spark, sf):
    return risk.warmup_split(numbered(spark, sf)).select("trajectory_id", "trip_no", "split")


@query(
    "rsk9_unseen_users",
    q(BASE, """SELECT user_id, row_number() OVER (ORDER BY h) <= floor(count(*) OVER () * 0.2::DOUBLE) AS is_unseen
      FROM (SELECT CAST(uid AS VARCHAR) AS user_id, sha256(uid || ':42') AS h FROM (SELECT DISTINCT uid FROM base))"""),
)
def unseen(spark, sf):
    u = adapter.users(spark, sf).select(F.col("uid").cast("string").alias("user_id"))
    return risk.unseen_users(u)


UNSEEN = WARM + """,
un AS (SELECT user_id, row_number() OVER (ORDER BY h) <= floor(count(*) OVER () * 0.2::DOUBLE) AS is_unseen
  FROM (SELECT user_id, sha256(user_id || ':42') AS h FROM (SELECT DISTINCT user_id FROM feat))),
kf AS (SELECT f.*, ws.trip_no, ws.split FROM feat f JOIN ws USING (user_id, trajectory_id) JOIN un USING (user_id) WHERE NOT is_unseen),
uf AS (SELECT f.*, tn.trip_no, tn.n_trips FROM feat f JOIN tn USING (user_id, trajectory_id) JOIN un USING (user_id) WHERE is_unseen)"""
EXPAND = UNSEEN + """,
wf AS (SELECT * FROM kf),
wlong AS (""" + " UNION ALL ".join(
    f"SELECT user_id, trip_no, split, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM wf" for c in BASELINE_FEATURES
) + """),
past AS (
  SELECT l.user_id, a.base_no, l.feature, l.v FROM wlong l JOIN (SELECT DISTINCT user_id, trip_no AS base_no FROM wf WHERE split = 'train') a
    ON a.user_id = l.user_id AND l.trip_no < a.base_no WHERE l.split IN ('warmup', 'train') AND v IS NOT NULL
  UNION ALL SELECT user_id, 0, feature, v FROM wlong WHERE split IN ('warmup', 'train') AND v IS NOT NULL),
pm AS (SELECT *, median(v) OVER (PARTITION BY user_id, base_no, feature) AS m FROM past),
bl AS (SELECT user_id, base_no, feature, count(*) AS n, CASE WHEN count(*) >= 10 THEN min(m) END AS median,
  CASE WHEN count(*) >= 10 THEN 1.4826*median(abs(v-m)) END AS robust_scale,
  CASE WHEN count(*) >= 10 THEN quantile_cont(v, 0.95) END AS p95 FROM pm GROUP BY 1, 2, 3)"""


@query(
    "rsk10_expanding_baselines",
    q(EXPAND, "SELECT user_id, base_no, feature, n AS sample_size, round(median, 5) AS median, round(robust_scale, 5) AS robust_scale, round(p95, 5) AS p95 FROM bl"),
)
def expanding(spark, sf):
    known, _ = risk.held_out(store(feature_table(spark, sf)))
    b = risk.expanding_baselines(risk.split_windows(known))
    return rounded(b.drop("mad"), 5, ["median", "robust_scale", "p95"])


KNOWN = judged_sql(
    EXPAND,
    "SELECT *, CASE WHEN split = 'train' THEN trip_no ELSE 0 END AS bno FROM wf WHERE split <> 'warmup'",
    "b.user_id = w.user_id AND b.base_no = w.bno",
)


@query(
    "rsk10_known_cohort",
    q(KNOWN, f"SELECT window_id, split, round(max_mad_z_score, 3) AS max_mad_z_score, {', '.join(TARGETS)} FROM tg"),
)
def known(spark, sf):
    k = risk.known_cohort(feature_table(spark, sf))
    return rounded(k.select("window_id", "split", "max_mad_z_score", *TARGETS), 3, ["max_mad_z_score"])


ZERO = judged_sql(
    UNSEEN + """,
pl AS (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM kf WHERE split IN ('warmup', 'train')" for c in BASELINE_FEATURES
    ) + """),
pmed AS (SELECT *, median(v) OVER (PARTITION BY feature) AS m FROM pl WHERE v IS NOT NULL),
bl AS (SELECT feature, min(m) AS median, 1.4826*median(abs(v-m)) AS robust_scale, quantile_cont(v, 0.95) AS p95 FROM pmed GROUP BY 1)""",
    "SELECT * FROM uf",
    "true",
)


@query(
    "rsk11_unseen_zero_shot",
    q(ZERO, f"SELECT window_id, round(max_mad_z_score, 3) AS max_mad_z_score, p95_exceedance_count, {', '.join(TARGETS)} FROM tg"),
)
def zero_shot(spark, sf):
    out = risk.unseen_cohorts(store(feature_table(spark, sf))).where("cohort = 'zero_shot'")
    return rounded(out.select("window_id", "max_mad_z_score", "p95_exceedance_count", *TARGETS), 3, ["max_mad_z_score"])


ADAPT = judged_sql(
    UNSEEN + """,
al AS (""" + " UNION ALL ".join(
        f"SELECT user_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM uf WHERE trip_no <= 7 AND n_trips > 7" for c in BASELINE_FEATURES
    ) + """),
am AS (SELECT *, median(v) OVER (PARTITION BY user_id, feature) AS m FROM al WHERE v IS NOT NULL),
bl AS (SELECT user_id, feature, CASE WHEN count(*) >= 10 THEN min(m) END AS median,
  CASE WHEN count(*) >= 10 THEN 1.4826*median(abs(v-m)) END AS robust_scale,
  CASE WHEN count(*) >= 10 THEN quantile_cont(v, 0.95) END AS p95 FROM am GROUP BY 1, 2)""",
    "SELECT * FROM uf WHERE trip_no > 7 AND n_trips > 7", "b.user_id = w.user_id",
)


@query(
    "rsk11_unseen_adapted",
    q(ADAPT, f"SELECT window_id, trip_no AS trip_index, round(max_mad_z_score, 3) AS max_mad_z_score, {', '.join(TARGETS)} FROM tg"),
)
def adapted(spark, sf):
    out = risk.unseen_cohorts(store(feature_table(spark, sf))).where("cohort = 'adapted'")
    out = out.withColumn("trip_index", F.col("trip_index").cast("bigint"))
    return rounded(out.select("window_id", "trip_index", "max_mad_z_score", *TARGETS), 3, ["max_mad_z_score"])


PLANTED = WARM + """,
ps AS (SELECT trajectory_id, split FROM ws UNION ALL
  SELECT trajectory_id, 'test' FROM ws WHERE split = 'train' AND trip_no % 5 = 0),
both_ AS (SELECT trajectory_id FROM ps WHERE split <> 'warmup' GROUP BY 1 HAVING count(DISTINCT split) > 1)"""


@query(
    "rsk14_split_leak_audit",
    q(PLANTED, """SELECT split, count(*) AS trips, count(both_.trajectory_id) AS shared
      FROM ps LEFT JOIN both_ USING (trajectory_id) WHERE split <> 'warmup' GROUP BY 1"""),
)
def leak_audit(spark, sf):
    """A clean split with planted leaks (every fifth training trip is also put into test): the audit must find them."""
    clean = risk.warmup_split(numbered(spark, sf)).select("trajectory_id", "trip_no", "split")
    planted = clean.where("split = 'train' AND trip_no % 5 = 0").withColumn("split", F.lit("test"))
    split = store(clean.unionByName(planted).where("split <> 'warmup'"))
    shared = risk.shared_trips(split)
    flagged = split.join(shared.withColumn("hit", F.lit(1)), "trajectory_id", "left")
    return flagged.groupBy("split").agg(
        F.count("*").alias("trips"), F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("shared")
    )


# --- evaluation -----------------------------------------------------------------------------

HORIZONS = RiskRules().horizons_s
SCORED = BASE + """,
scored AS (
  SELECT m.model, h.horizon_s, CASE WHEN (k + v % 7 + h.i) % 3 = 0 THEN 1 ELSE 0 END AS y,
    ((v*(7919+m.i) + k*104729) % 10007)/10007.0e0*0.7e0
      + CASE WHEN (k + v % 7 + h.i) % 3 = 0 THEN 0.3e0 ELSE 0.0e0 END AS p,
    CAST(v % 60 AS DOUBLE)/10.0e0 AS z, CAST(k % 6 AS DOUBLE) AS c
  FROM base, (VALUES ('boosted', 0), ('forest', 1), ('wide_boosted', 2)) m(model, i),
    (VALUES (120, 0), (360, 1), (600, 2), (840, 3)) h(horizon_s, i))"""
MODEL_KEYS = ["model", "horizon_s"]


def scored(spark, sf):
    """Scores of three models and four horizons derived from the events."""
    names = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.lit(i).alias("mi")) for i, n in enumerate(("boosted", "forest", "wide_boosted"))
    ])).alias("m")
    spans = F.explode(F.array(*[
        F.struct(F.lit(h).cast("bigint").alias("horizon_s"), F.lit(i).alias("hi")) for i, h in enumerate(HORIZONS)
    ])).alias("h")
    b = adapter.base(spark, sf).select("k", "v", names).select("k", "v", "m.*", spans).select("k", "v", "model", "mi", "h.*")
    b = b.withColumn("y", F.expr("CASE WHEN (k + v % 7 + hi) % 3 = 0 THEN 1L ELSE 0L END"))
    return b.select(
        *MODEL_KEYS, "y",
        F.expr("((v*(7919+mi) + k*104729) % 10007)/10007.0D*0.7D + CASE WHEN y = 1 THEN 0.3D ELSE 0.0D END").alias("p"),
        F.expr("CAST(v % 60 AS DOUBLE)/10.0D").alias("z"),
        F.expr("CAST(k % 6 AS DOUBLE)").alias("c"),
    )


RATES = [
    "prevalence", "precision_pos", "recall_pos", "f1_pos", "precision_neg", "recall_neg", "f1_neg", "macro_f1",
    "fpr", "specificity", "balanced_accuracy", "accuracy",
]
RATES_SQL = """tp, fp, fn, tn, tp+fp+fn+tn AS n_samples,
 coalesce((tp+fn)/nullif(tp+fp+fn+tn, 0)::DOUBLE, 0.0) AS prevalence,
 coalesce(tp/nullif(tp+fp, 0)::DOUBLE, 0.0) AS precision_pos, coalesce(tp/nullif(tp+fn, 0)::DOUBLE, 0.0) AS recall_pos,
 coalesce(2*tp/nullif(2*tp+fp+fn, 0)::DOUBLE, 0.0) AS f1_pos, coalesce(tn/nullif(tn+fn, 0)::DOUBLE, 0.0) AS precision_neg,
 coalesce(tn/nullif(tn+fp, 0)::DOUBLE, 0.0) AS recall_neg, coalesce(2*tn/nullif(2*tn+fp+fn, 0)::DOUBLE, 0.0) AS f1_neg,
 (coalesce(2*tp/nullif(2*tp+fp+fn, 0)::DOUBLE, 0.0) + coalesce(2*tn/nullif(2*tn+fp+fn, 0)::DOUBLE, 0.0))
   / ((CASE WHEN tp+fp+fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn+fp+fn > 0 THEN 1 ELSE 0 END)) AS macro_f1,
 coalesce(fp/nullif(fp+tn, 0)::DOUBLE, 0.0) AS fpr, coalesce(tn/nullif(tn+fp, 0)::DOUBLE, 0.0) AS specificity,
 (coalesce(tp/nullif(tp+fn, 0)::DOUBLE, 0.0) + coalesce(tn/nullif(tn+fp, 0)::DOUBLE, 0.0))/2 AS balanced_accuracy,
 (tp+tn)/(tp+fp+fn+tn)::DOUBLE AS accuracy"""


def cm_sql(hit: str) -> str:
    return f"""count(*) FILTER (WHERE y = 1 AND {hit}) AS tp, count(*) FILTER (WHERE y = 0 AND {hit}) AS fp,
 count(*) FILTER (WHERE y = 1 AND NOT ({hit})) AS fn, count(*) FILTER (WHERE y = 0 AND NOT ({hit})) AS tn"""


def tuned_sql(name: str, score: str, candidates, group: str = "model, horizon_s") -> str:
    """Rates at every candidate threshold, as CTEs ``<name>c`` and ``<name>``."""
    values = ", ".join(f"({c!r}::DOUBLE)" for c in candidates)
    return f""",
{name}c AS (SELECT {group}, threshold, {cm_sql(f'{score} >= threshold')}
  FROM scored, (VALUES {values}) g(threshold) GROUP BY ALL),
{name} AS (SELECT {group}, threshold, {RATES_SQL} FROM {name}c)"""


BEST_SQL = """SELECT model, horizon_s, round(threshold, 6) AS threshold, round(macro_f1, 6) AS macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model, horizon_s ORDER BY round(macro_f1, 12) DESC, threshold) AS r FROM t) WHERE r = 1"""


def _tuning(name: str, score: str, candidates) -> None:
    @query(name, q(SCORED + tuned_sql("t", score, candidates), BEST_SQL))
    def tuned(spark, sf):
        table = metrics.threshold_table(scored(spark, sf), MODEL_KEYS, candidates, score)
        return rounded(metrics.best_macro_f1(table, MODEL_KEYS), 6, ["threshold", "macro_f1"])


_tuning("rsk12_mad_threshold", "z", metrics.MAD_GRID)
_tuning("rsk13_exceedance_threshold", "c", metrics.COUNT_GRID)
_tuning("mdl5_probability_threshold", "p", metrics.PROBABILITY_GRID)


@query(
    "rsk12_heuristic_scores",
    q(SCORED, """SELECT model, horizon_s, round(sum(1/(1+exp(-(z-3.0e0)))), 4) AS mad_sum,
      round(sum(least(c/8, 1.0)), 4) AS exceedance_sum FROM scored GROUP BY 1, 2"""),
)
def heuristic_scores(spark, sf):
    return scored(spark, sf).groupBy(*MODEL_KEYS).agg(
        F.round(F.sum(metrics.mad_probability(3.0, "z")), 4).alias("mad_sum"),
        F.round(F.sum(metrics.exceedance_probability(8, "c")), 4).alias("exceedance_sum"),
    )


@query("met1_binary_metrics", q(SCORED, f"SELECT model, horizon_s, tp, fp, fn, tn, n_samples, {rnd(RATES[:8])} FROM (SELECT model, horizon_s, {RATES_SQL} FROM (SELECT model, horizon_s, {cm_sql('p >= 0.5')} FROM scored GROUP BY 1, 2))"))
def binary_metrics(spark, sf):
    s = scored(spark, sf).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    m = metrics.binary_metrics(s, MODEL_KEYS)
    return rounded(m.select(*MODEL_KEYS, "tp", "fp", "fn", "tn", "n_samples", *RATES[:8]), 6, RATES[:8])


@query("met5_error_rates", q(SCORED, f"SELECT model, horizon_s, {rnd(RATES[8:])} FROM (SELECT model, horizon_s, {RATES_SQL} FROM (SELECT model, horizon_s, {cm_sql('p >= 0.4')} FROM scored GROUP BY 1, 2))"))
def error_rates(spark, sf):
    s = scored(spark, sf).withColumn("yhat", (F.col("p") >= 0.4).cast("int"))
    return rounded(metrics.binary_metrics(s, MODEL_KEYS).select(*MODEL_KEYS, *RATES[8:]), 6, RATES[8:])


CURVE = SCORED + """,
cc AS (SELECT model, horizon_s, p, CAST(sum(y) AS BIGINT) AS pos, count(*) - CAST(sum(y) AS BIGINT) AS neg FROM scored GROUP BY 1, 2, 3),
cv AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    sum(pos) OVER g AS np, sum(neg) OVER g AS nn FROM cc
  WINDOW w AS (PARTITION BY model, horizon_s ORDER BY p DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY model, horizon_s))"""


def _ranking(name: str, column: str, sql: str) -> None:
    @query(name, q(CURVE, sql))
    def ranking(spark, sf):
        r = metrics.ranking_metrics(scored(spark, sf), MODEL_KEYS)
        return rounded(r.select(*MODEL_KEYS, column), 6, [column])


_ranking("met2_roc_auc", "roc_auc", "SELECT model, horizon_s, round(sum(neg*(tp-pos/2.0))/(min(np)*min(nn)), 6) AS roc_auc FROM cv GROUP BY 1, 2")
_ranking("met3_average_precision", "pr_auc", "SELECT model, horizon_s, round(sum(pos*tp/(tp+fp)::DOUBLE)/min(np), 6) AS pr_auc FROM cv GROUP BY 1, 2")
_ranking("met4_brier", "brier_score", "SELECT model, horizon_s, round(avg(pow(p-y, 2)), 6) AS brier_score FROM scored GROUP BY 1, 2")


@query(
    "met6_curve_points",
    q(CURVE, """SELECT model, horizon_s, round(p, 9) AS threshold, tp/(tp+fp)::DOUBLE AS precision,
      tp/np::DOUBLE AS recall, fp/nn::DOUBLE AS fpr FROM cv"""),
)
def curve_points(spark, sf):
    c = metrics.curve_points(scored(spark, sf), MODEL_KEYS)
    return rounded(c, 9, ["threshold"])


FLOORS = {120: 0.75, 360: 0.85, 600: 0.88, 840: 0.88}
FLOOR_SQL = "CASE horizon_s " + " ".join(f"WHEN {h} THEN {v}" for h, v in FLOORS.items()) + " END"
FLOORED = """
fl AS (SELECT model, horizon_s, threshold, ok FROM (SELECT *, row_number() OVER (PARTITION BY model, horizon_s ORDER BY ok DESC,
  CASE WHEN ok THEN round(specificity, 12) END DESC NULLS LAST, round(recall_pos, 12) DESC, threshold) AS r FROM (
  SELECT *, recall_pos >= """ + FLOOR_SQL + """ AS ok FROM t)) WHERE r = 1)"""


@query(
    "met7_threshold_under_recall_floor",
    q(SCORED + tuned_sql("t", "p", metrics.RECALL_GRID) + "," + FLOORED,
      "SELECT model, horizon_s, ok AS floor_met, round(threshold, 6) AS threshold FROM fl"),
)
def recall_floor(spark, sf):
    table = metrics.threshold_table(scored(spark, sf), MODEL_KEYS, metrics.RECALL_GRID)
    picked = metrics.threshold_under_recall_floor(table, MODEL_KEYS, F.expr(FLOOR_SQL))
    return rounded(picked, 6, ["threshold"])


DELTAS = [f"delta_{m}" for m in metrics.DELTA_METRICS]


@query(
    "met8_operating_point_deltas",
    q(SCORED + f""",
    a AS (SELECT model, horizon_s, {RATES_SQL} FROM (SELECT model, horizon_s, {cm_sql('p >= 0.5')} FROM scored GROUP BY 1, 2)),
    b AS (SELECT model, horizon_s, {RATES_SQL} FROM (SELECT model, horizon_s, {cm_sql('p >= 0.6')} FROM scored GROUP BY 1, 2))""",
      "SELECT model, horizon_s, b.fp-a.fp AS delta_fp, b.fn-a.fn AS delta_fn, "
      + ", ".join(f"round(b.{m}-a.{m}, 6) + 0.0 AS delta_{m}" for m in metrics.DELTA_METRICS)
      + " FROM a JOIN b USING (model, horizon_s)"),
)
def deltas(spark, sf):
    s = scored(spark, sf)
    at = lambda t: metrics.binary_metrics(s.withColumn("yhat", (F.col("p") >= t).cast("int")), MODEL_KEYS)
    return rounded(metrics.metric_deltas(at(0.5), at(0.6), MODEL_KEYS), 6, DELTAS)


@query(
    "met10_best_models",
    q(CURVE + """,
    s AS (SELECT model, horizon_s, sum(neg*(tp-pos/2.0))/(min(np)*min(nn)) AS roc_auc, sum(pos*tp/(tp+fp)::DOUBLE)/min(np) AS pr_auc FROM cv GROUP BY 1, 2),
    br AS (SELECT model, horizon_s, avg(pow(p-y, 2)) AS brier_score FROM scored GROUP BY 1, 2),
    l AS (SELECT model, horizon_s, 'roc_auc' AS metric, roc_auc AS value, -roc_auc AS o FROM s
      UNION ALL SELECT model, horizon_s, 'pr_auc', pr_auc, -pr_auc FROM s
      UNION ALL SELECT model, horizon_s, 'brier_score', brier_score, brier_score FROM br)""",
      """SELECT model, horizon_s, metric, round(value, 6) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY horizon_s, metric ORDER BY o, model) AS r FROM l) WHERE r = 1"""),
)
def best_models(spark, sf):
    r = metrics.ranking_metrics(scored(spark, sf), MODEL_KEYS)
    best = metrics.winners(r, {"roc_auc": True, "pr_auc": True, "brier_score": False})
    return rounded(best, 6, ["value"])


@query(
    "mdl4_apply_calibration",
    q(SCORED, "SELECT model, horizon_s, y, round(p, 9) AS p, round(1/(1+exp(-(4.2*p-1.7))), 6) AS calibrated FROM scored"),
)
def apply_calibration(spark, sf):
    s = scored(spark, sf)
    return s.select(
        *MODEL_KEYS, "y", F.round("p", 9).alias("p"), F.round(metrics.calibrate("p", 4.2, -1.7), 6).alias("calibrated")
    )


# --- models ---------------------------------------------------------------------------------


HORIZONS = RiskRules().horizons_s


def _cohort(features):
    k = store(risk.known_cohort(features, extended=True))
    return {p: k.where(F.col("split") == p) for p in ("train", "val", "test")}


def _fits(spark, d, fit, **options):
    return models.fit_horizons(lambda h: fit(d["train"], d["val"], h, **options), HORIZONS, spark)


def _predictions(spark, sf, fit, **options):
    """Scores of the test rows at every horizon, long."""
    d = _cohort(store(feature_table(spark, sf, 250)))
    fitted = _fits(spark, d, fit, **options)
    return reduce(DataFrame.unionByName, [models.score(d["test"], fitted[h], h) for h in HORIZONS])


@query("mdl1_boosted_predictions")
def boosted(spark, sf):
    return _predictions(spark, sf, models.fit_boosted)


@query("mdl2_forest_predictions")
def forest(spark, sf):
    return _predictions(spark, sf, models.fit_forest)


@query("mdl3_wide_boosted_predictions")
def wide_boosted(spark, sf):
    return _predictions(spark, sf, models.fit_boosted, wide=True)


FIXED = judged_sql(
    feat(250) + EXPAND.removeprefix(feat()),
    "SELECT *, CASE WHEN split = 'train' THEN trip_no ELSE 0 END AS bno FROM wf WHERE split <> 'warmup'",
    "b.user_id = w.user_id AND b.base_no = w.bno",
)


@query(
    "mdl6_scores_by_horizon",
    q(FIXED, " UNION ALL ".join(
        f"""SELECT window_id, user_id, trajectory_id, {h} AS horizon_s, target_{h}s AS y_true, true AS in_range, true AS rule_holds
        FROM tg WHERE split = 'test'""" for h in HORIZONS
    )),
)
def by_horizon(spark, sf):
    """The fixed part of the scores: rows, truth, horizon, and that decision and probability agree."""
    p = _predictions(spark, sf, models.fit_boosted)
    inside = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return p.select(
        "window_id", "user_id", "trajectory_id", "horizon_s", "y_true",
        (inside("raw_probability") & inside("calibrated_probability")).alias("in_range"),
        F.col("y_pred").eqNullSafe(F.col("calibrated_probability") >= F.col("threshold")).alias("rule_holds"),
    )


@query("mdl7_top_inputs")
def top_inputs(spark, sf):
    fitted = _fits(spark, _cohort(store(feature_table(spark, sf, 250))), models.fit_boosted)
    each = [models.importances(fitted[h], spark).withColumn("horizon_s", F.lit(h)) for h in HORIZONS]
    return reduce(DataFrame.unionByName, each)
