"""Ordered scans that never put one whole key into one task.

A plain window over ``partitionBy(key).orderBy(t)`` sends a hot key to a single task.  Here each
key is cut into chunks (a slice of time, or of source positions).  The scan runs inside
``(key, chunk)``, one summary row per chunk is scanned per key, and the value carried into each
chunk is joined back.  The number of summary rows per key is bounded by the calendar, not by the
number of readings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(value: Column) -> tuple[str, Column]:
    """Sum up to and including the row."""
    return "sum", value


def running_max(value: Column) -> tuple[str, Column]:
    """Largest value up to and including the row."""
    return "max", value


def max_before(value: Column) -> tuple[str, Column]:
    """Largest value on earlier rows."""
    return "maxb", value


def last_seen(value: Column) -> tuple[str, Column]:
    """Last non-null value up to and including the row."""
    return "last", value


def seen_before(value: Column) -> tuple[str, Column]:
    """Last non-null value on an earlier row."""
    return "before", value


def previous(value: Column) -> tuple[str, Column]:
    """Value on the row just before, null or not."""
    return "prev", value


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column,
    lanes: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Add one column per lane.  ``chunk`` must not decrease along ``order``."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    base = df.withColumn("_chunk", chunk)
    for name, (_, value) in lanes.items():
        base = base.withColumn(f"_in_{name}", value)

    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    local, summary, carried = {}, [], {}
    per_key = Window.partitionBy(*keys).orderBy("_chunk")
    past = per_key.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*[_ascending(o, i) for i, o in enumerate(order)])
    for name, (kind, _) in lanes.items():
        v = F.col(f"_in_{name}")
        if kind == "sum":
            local[name] = F.sum(v).over(upto)
            summary.append(F.sum(v).alias(f"_sum_{name}"))
            carried[f"_car_{name}"] = F.sum(f"_sum_{name}").over(past)
        elif kind == "max":
            local[name] = F.max(v).over(upto)
            summary.append(F.max(v).alias(f"_sum_{name}"))
            carried[f"_car_{name}"] = F.max(f"_sum_{name}").over(past)
        elif kind == "maxb":
            local[name] = F.max(v).over(earlier)
            summary.append(F.max(v).alias(f"_sum_{name}"))
            carried[f"_car_{name}"] = F.max(f"_sum_{name}").over(past)
        elif kind in ("last", "before"):
            frame = upto if kind == "last" else earlier
            local[name] = F.last(v, ignorenulls=True).over(frame)
            at = F.when(v.isNotNull(), position)
            summary.append(F.max_by(v, at).alias(f"_sum_{name}"))
            carried[f"_car_{name}"] = F.last(f"_sum_{name}", ignorenulls=True).over(past)
        elif kind == "prev":
            local[name] = F.lag(F.struct(v.alias("v"))).over(within)
            summary.append(F.max_by(F.struct(v.alias("v")), position).alias(f"_sum_{name}"))
            carried[f"_car_{name}"] = F.lag(f"_sum_{name}").over(per_key)
        else:
            raise ValueError(f"unknown lane kind {kind}")

    chunks = base.groupBy(*keys, "_chunk").agg(*summary)
    carry = chunks.select(*keys, "_chunk", *[c.alias(n) for n, c in carried.items()])
    scanned = base.select("*", *[c.alias(f"_loc_{n}") for n, c in local.items()])
    joined = scanned.join(carry, [*keys, "_chunk"], "left")
    out = {}
    for name, (kind, _) in lanes.items():
        loc, car = F.col(f"_loc_{name}"), F.col(f"_car_{name}")
        if kind == "sum":
            out[name] = F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
        elif kind in ("max", "maxb"):
            out[name] = F.greatest(loc, car)
        elif kind == "prev":
            out[name] = F.coalesce(loc, car)["v"]
        else:
            out[name] = F.coalesce(loc, car)
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def _ascending(order: Column, i: int) -> Column:
    """The order expression itself; descending scans negate their key instead of using desc()."""
    return order.alias(f"o{i}")


def time_chunk(us: str | Column, seconds: int) -> Column:
    """Slice number of a microsecond clock."""
    us = F.col(us) if isinstance(us, str) else us
    return F.floor(us / F.lit(seconds * 1_000_000)).cast("bigint")
