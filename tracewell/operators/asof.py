"""As-of join: the newest row of one table at the time of each row of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scan import ordered_scan, seen_before, time_chunk


def asof_last(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str = "t_us",
    tie: str = "event_id",
    max_age_s: float | None = None,
    name: str = "last",
    chunk_s: int = 3600,
) -> DataFrame:
    """Add ``name``: struct of the newest right row with ``right.time <= left.time``, and its age.

    Both tables are put into one sequence and scanned once, so no pairs are formed.  Rows of the
    right table come first at equal times.
    """
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    body = [c for c in left.columns if c not in (*keys, time, tie)]
    lrow = left.select(
        *keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"),
        F.struct(F.lit(True).alias("_"), *body).alias("_left"),
    )
    rrow = right.select(
        *keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"),
        F.struct(*rest).alias("_right"),
    )
    both = lrow.unionByName(rrow, allowMissingColumns=True)
    scanned = ordered_scan(
        both,
        keys,
        ["_t", "_side", "_tie"],
        time_chunk("_t", chunk_s),
        {"_last": seen_before(F.col("_right"))},
    ).where("_side = 1")
    age = (F.col("_t") - F.col(f"_last.{time}")) / 1e6
    fresh = F.lit(True) if max_age_s is None else age <= max_age_s
    return scanned.select(
        *keys,
        F.col("_t").alias(time),
        F.col("_tie").alias(tie),
        *[F.col(f"_left.{c}").alias(c) for c in body],
        F.when(fresh, F.col("_last")).alias(name),
        age.alias(f"{name}_age_s"),
    )
