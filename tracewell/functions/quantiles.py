"""Exact percentiles (linear interpolation) that survive a group holding most of the rows.

The general path takes groups of every size.  Equal values of a group are counted first, so copies collapse before any shuffle.  The counted
values fall into buckets by a fixed, order-preserving rule; a group's buckets (a few hundred in practice) are summed from small to
large, which tells the bucket of every wanted rank.  Such a bucket is divided once more, evenly between its least and its greatest
value, so that values of one size (times, longitudes) part too; only the places that hold a wanted rank are put in order.  No value
of a group is ever gathered.  Spread and distribution use the counts and the percentiles several times, so they store
both.

Most groups of a spread are small (the windows of one user), and for them those joins cost far more than the values.  So a spread
gathers groups of up to ``GATHERED`` values as one sorted array each, in one shuffle; larger groups, if there are any, go by buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import MAD_TO_SIGMA
from tracewell.session import store

#: Buckets per doubling of a value.
STEPS = 64
#: Equal places that a bucket is divided into, from its least to its greatest value.
PLACES = 256
#: Values of a group that a spread puts in order as one array.
GATHERED = 10_000
#: Above the bucket number of the smallest positive double.
SHIFT = 1100 * STEPS


def _bucket(v: Column) -> Column:
    """Number of a value's bucket; never falls while the value rises."""
    size = F.floor(F.log2(F.abs(v)) * STEPS) + SHIFT
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("bigint")


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys meet too; without keys ``right`` is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, on).drop(*[f"_r_{k}" for k in keys])


def _counted(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """``keys, _v, _c``: distinct values and how often they occur; nulls are left out."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, (value.cast("double") + 0.0).alias("_v")).where(F.col("_v").isNotNull())
    return rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))


def _at_ranks(counted: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per key with ``n`` and the percentile array ``q``."""
    keys = list(keys)
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranks = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.alias("rank"), weight.alias("weight"))
        for i, p in enumerate(probs)
        for side, (rank, weight) in enumerate(_neighbours(p))
    ])
    whole = sizes.select(*keys, F.lit(0).cast("bigint").alias("_start"), ranks.alias("_w"))
    coarse, found = _narrowed(counted.withColumn("_b", _bucket(F.col("_v"))), keys, "_b", whole)
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PLACES), F.lit(PLACES - 1))
    inner = coarse.withColumn("_p", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(0).cast("bigint")).drop("_lo", "_hi")
    fine, found = _narrowed(inner, [*keys, "_b"], "_p", found)
    inside = Window.partitionBy(*keys, "_b", "_p").orderBy("_v")
    near = _join(fine.drop("_lo", "_hi"), found, [*keys, "_b", "_p"]).withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
    hit = F.filter("_w", lambda w: (w["rank"] < F.col("_end")) & (w["rank"] >= F.col("_end") - F.col("_c")))
    each = near.select(*keys, "_v", F.explode(hit).alias("_w"))
    at = lambda i, side, c: F.max(F.when((F.col("_w.i") == i) & (F.col("_w.side") == side), F.col(c)))
    # Between two equal values this is exactly that value, in whatever order rows come.
    between = lambda low, high, w: F.when(low == high, low).otherwise(low + (high - low) * w)
    parts = [between(at(i, 0, "_v"), at(i, 1, "_v"), at(i, 1, "_w.weight")).alias(f"_q{i}") for i in range(len(probs))]
    picked = _join(each.groupBy(*keys).agg(*parts), sizes, keys)
    return picked.select(*keys, F.col("_n").alias("n"), F.array(*[F.col(f"_q{i}") for i in range(len(probs))]).alias("q")).where("n > 0")


def _narrowed(rows: DataFrame, keys: list[str], part: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the parts that hold a wanted rank, with the part's least and greatest value, and those parts with what they hold.

    ``wanted`` has, per key, the number of values below the key (``_start``) and the ranks asked of it (``_w``).
    """
    sizes = rows.groupBy(*keys, part).agg(F.sum("_c").alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = _join(sizes.withColumn("_below", F.coalesce(F.sum("_size").over(order), F.lit(0))), wanted, keys)
    sizes = sizes.withColumn("_start", F.col("_start") + F.col("_below"))
    held = F.filter("_w", lambda w: (w["rank"] >= F.col("_start")) & (w["rank"] < F.col("_start") + F.col("_size")))
    found = sizes.select(*keys, part, "_start", held.alias("_w"), "_lo", "_hi").where(F.size("_w") > 0)
    return _join(rows, found.select(*keys, part, "_lo", "_hi"), [*keys, part]), found.drop("_lo", "_hi")


def _neighbours(p: float) -> list[tuple[Column, Column]]:
    at = (F.col("_n") - 1) * F.lit(float(p))
    low = F.floor(at)
    return [(low, 1 - (at - low)), (F.least(low + 1, F.col("_n") - 1), at - low)]


def percentiles(df: DataFrame, keys: Sequence[str], value: str | Column, probs: Sequence[float]) -> DataFrame:
    """One row per key with ``n`` (non-null values) and ``q``, an array aligned with ``probs``."""
    return _at_ranks(_counted(df, keys, value), keys, probs)


def _about(counted: DataFrame, keys: Sequence[str], base: DataFrame) -> DataFrame:
    """Sums over the counted values about the median ``_med`` of their key: ``mean``, ``min``, ``max`` and squares ``_ss``.

    Distances from the median are short, so the squares do not cancel.
    """
    off = F.col("_v") - F.col("_med")
    sums = _join(counted, base, keys).groupBy(*keys).agg(
        F.sum("_c").alias("_m"), F.sum(off * F.col("_c")).alias("_s1"), F.sum(off * off * F.col("_c")).alias("_s2"),
        F.max("_med").alias("_at"), F.min("_v").alias("min"), F.max("_v").alias("max"),
    )
    mean = F.col("_at") + F.col("_s1") / F.col("_m")
    squares = F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_m"), F.lit(0.0))
    return sums.select(*keys, mean.alias("mean"), "min", "max", squares.alias("_ss"), "_m")


def spread(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """Count, median, P95, P99, MAD, robust scale, mean, variance and minimum per key."""
    keys = list(keys)
    counted = store(_counted(df, keys, value))
    if not keys:
        return _spread_by_buckets(counted, keys)
    large = store(counted.groupBy(*keys).agg(F.sum("_c").alias("_n")).where(F.col("_n") > GATHERED).select(*keys))
    if large.isEmpty():
        return _spread_gathered(counted, keys)
    part = lambda how: _matching(counted, large, keys, how)
    return _spread_gathered(part("left_anti"), keys).unionByName(_spread_by_buckets(store(part("left_semi")), keys))


def _matching(rows: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    other = groups.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    return rows.join(F.broadcast(other), [rows[k].eqNullSafe(other[f"_r_{k}"]) for k in keys], how)


SPREAD = ("sample_size", "median", "p95", "p99", "mean", "variance", "min", "mad", "robust_scale")


def _spread_gathered(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Spread of groups that are small enough for one sorted array."""
    copies = F.transform(F.array_sort(F.collect_list(F.struct("_v", "_c"))), lambda x: F.array_repeat(x["_v"], x["_c"].cast("int")))
    return spread_sorted(counted.groupBy(*keys).agg(F.flatten(copies).alias("_s")), keys)


def spread_sorted(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread of rows that each hold one group: ``keys`` and the sorted array ``_s``, which is not empty."""

    def at(values: str, p: float) -> Column:
        place = (F.col("sample_size") - 1) * F.lit(p)
        low = F.floor(place)
        a, b = (F.element_at(values, (i + 1).cast("int")) for i in (low, F.least(low + 1, F.col("sample_size") - 1)))
        return F.when(a == b, a).otherwise(a + (b - a) * (place - low))

    sorted_ = lists.withColumn("sample_size", F.size("_s").cast("bigint"))
    middle = sorted_.withColumn("median", at("_s", 0.5)).withColumn("_off", F.transform("_s", lambda v: v - F.col("median")))
    zero = F.lit(0.0)
    sums = F.struct(
        F.aggregate("_off", zero, lambda s, d: s + d).alias("s1"), F.aggregate("_off", zero, lambda s, d: s + d * d).alias("s2"),
    )
    whole = middle.withColumns({"_away": F.array_sort(F.transform("_off", F.abs)), "_sums": sums})
    s1, n = F.col("_sums.s1"), F.col("sample_size")
    squares = F.greatest(F.col("_sums.s2") - s1 * s1 / n, zero)
    return whole.withColumns({
        "p95": at("_s", 0.95), "p99": at("_s", 0.99), "mean": F.col("median") + s1 / n,
        "variance": F.when(n > 1, squares / (n - 1)), "min": F.element_at("_s", 1), "mad": at("_away", 0.5),
    }).select(*keys, *SPREAD[:-1], (F.col("mad") * MAD_TO_SIGMA).alias("robust_scale"))


def _spread_by_buckets(counted: DataFrame, keys: list[str]) -> DataFrame:
    base = store(_at_ranks(counted, keys, [0.5, 0.95, 0.99]).select(
        *keys, F.col("n").alias("sample_size"), F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99")
    ))
    centre = base.select(*keys, F.col("median").alias("_med"))
    away = _join(counted, centre, keys).groupBy(*keys, F.abs(F.col("_v") - F.col("_med")).alias("_v")).agg(F.sum("_c").alias("_c"))
    mad = _at_ranks(away, keys, [0.5]).select(*keys, F.col("q")[0].alias("mad"))
    whole = _join(_join(base, _about(counted, keys, centre), keys), mad, keys)
    return whole.select(
        *keys, "sample_size", "median", "p95", "p99", "mean",
        F.when(F.col("_m") > 1, F.col("_ss") / (F.col("_m") - 1)).alias("variance"),
        "min", "mad", (F.col("mad") * MAD_TO_SIGMA).alias("robust_scale"),
    )


STATS = ("count", "min", "max", "mean", "std", "p25", "p50", "p75", "p95", "p99")


def distribution(df: DataFrame, keys: Sequence[str], value: str, sample_std: bool = False) -> DataFrame:
    """Count, range, mean, deviation and five percentiles per key."""
    keys = list(keys)
    counted = store(_counted(df, keys, value))
    ranked = store(_at_ranks(counted, keys, [0.25, 0.5, 0.75, 0.95, 0.99]))
    about = _about(counted, keys, ranked.select(*keys, F.col("q")[1].alias("_med")))
    least = 1 if sample_std else 0
    std = F.when(F.col("_m") > least, F.sqrt(F.col("_ss") / (F.col("_m") - least)))
    return _join(ranked, about, keys).select(
        *keys,
        F.col("n").alias("count"),
        "min",
        "max",
        "mean",
        std.alias("std"),
        *[F.col("q")[i].alias(n) for i, n in enumerate(STATS[5:])],
    )
