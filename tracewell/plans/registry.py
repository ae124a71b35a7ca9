"""Registry of queries: name -> (spark, folder) callable, plus the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, columns: Iterable[str]) -> DataFrame:
    """Round doubles so that two engines can be compared."""
    columns = set(columns)
    return df.select(
        *[(F.round(F.col(c), digits) + 0.0).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def rnd(columns: Iterable[str], digits: int = 6) -> str:
    """The same rounding as SQL select items."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def load() -> None:
    """Import all query modules (each registers itself)."""
    from tracewell.plans import (  # noqa: F401
        context_queries,
        ingest_queries,
        online_queries,
        profile_queries,
        risk_queries,
        serving_queries,
        state_queries,
        stream_queries,
        window_queries,
    )
