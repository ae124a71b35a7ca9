"""Streams assembled from the handlers: cleaning of the stream, windows, monitoring, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators import cleaning, states
from tracewell.operators.zones import with_zone_distances
from tracewell.session import ROCKSDB_PROVIDER
from tracewell.streaming.ordered import ByBuckets, bucket
from tracewell.streaming.processors import EvidenceMonitor, LatestFix, TrailingHistory, UserMonitor, WindowBuilder

LATE = "300 seconds"
#: User of the row that closes a stream.
CLOSING_USER = "__closing__"


def prepare(spark: SparkSession) -> None:
    """Keyed state with several variables and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    # A batch uploads what it changed, not the files of the whole store.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def deduplicated(stream: DataFrame, late: str = LATE) -> DataFrame:
    """One reading per user and time; later copies within the watermark are dropped."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["user_id", "event_time"])


def consented_stream(stream: DataFrame, consent: DataFrame) -> DataFrame:
    """Stream joined with the consent table; users without consent are not processed."""
    return cleaning.consented(stream, consent)


def _timed(stream: DataFrame, handler, schema: str, late: str, *more: str) -> DataFrame:
    prepare(stream.sparkSession)
    slim = stream.select("user_id", "event_id", "event_time", "t_us", "latitude", "longitude", *more)
    return slim.withWatermark("event_time", late).withColumn("bucket", bucket()).groupBy("bucket").transformWithStateInPandas(ByBuckets(handler), schema, "Append", "EventTime")


def window_stream(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Closed windows of ``user_id, event_id, event_time, t_us, latitude, longitude``.

    Fixes count in event-time order if the watermark still admits them.  A row of :func:`closing_row` at the end of a stream closes
    the windows that are still open.
    """
    return _timed(stream, WindowBuilder(), schemas.WINDOWS_OUT, late)


def evidence_stream(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Per reading the last window of its user that was closed by then; columns as for :func:`window_stream`."""
    schema = "user_id string, event_id bigint, t_us bigint, window_id string, open_points bigint, evidence_status string"
    return _timed(stream, EvidenceMonitor(), schema, late)


def history_stream(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Extent of the trailing history at every reading."""
    return _timed(stream, TrailingHistory(), "user_id string, event_id bigint, history_points int, history_s double", late)


def closing_row(rows: DataFrame, after_s: int = 3600) -> DataFrame:
    """One row far behind the newest of ``rows`` (a table with ``user_id, event_id, t_us``) under a user of its own.

    Written last to a stream's source it moves the watermark past all other rows, so that nothing stays held back.
    """
    end = rows.agg((F.max("t_us") + after_s * 1_000_000).alias("t_us"))
    typed = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in ("user_id", "event_id", "t_us")]
    return end.select(F.lit(CLOSING_USER).alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), "t_us", *typed).select(*rows.columns)


def monitor_stream(stream: DataFrame, zones: DataFrame) -> DataFrame:
    """Displacement tier, geofence states and frozen score per reading (and zone).

    Needs ``user_id, event_id, t_us, latitude, longitude, accuracy_m, is_degraded,
    net_displacement_m, score`` (score null while a window fills).
    """
    prepare(stream.sparkSession)
    ids, far = (F.transform("zone_distances", lambda z: z[n]).alias(a) for n, a in (("zone_id", "zone_ids"), ("distance", "zone_m")))
    # Few large files would leave the distances to few tasks.
    rows = with_zone_distances(stream.repartition("user_id"), zones).select(
        "user_id", "event_id", "t_us", "accuracy_m", "is_degraded", "net_displacement_m", "score", ids, far
    )
    return rows.withColumn("bucket", bucket()).groupBy("bucket").transformWithStateInPandas(
        UserMonitor(), schemas.MONITOR_OUT, "Append", "None"
    )


def latest_fix_stream(patients: DataFrame, fixes: DataFrame, max_age_s: int = 60, late: str = LATE) -> DataFrame:
    """Every patient reading with the newest companion fix of the last minute (nulls without one), in one keyed handler."""
    both = patients.withColumn("is_reading", F.lit(True)).unionByName(fixes.withColumn("is_reading", F.lit(False)))
    schema = "user_id string, event_id bigint, t_us bigint, fix_us bigint, fix_event bigint, latitude double, longitude double"
    return _timed(both, LatestFix(max_age_s), schema, late, "is_reading")


def frozen_scores(readings: DataFrame) -> DataFrame:
    """Batch form of the freeze: the last valid score is held while the signal is degraded, and
    raised by a long displacement.  Needs ``score, is_degraded, net_displacement_m``."""
    from tracewell.config import ScoringRules
    from tracewell.functions.scan import ordered_scan, seen_before, time_chunk

    rules = ScoringRules()
    good = F.when(~F.col("is_degraded"), F.struct("score", "t_us"))
    held = ordered_scan(
        readings, ["user_id"], ["t_us", "event_id"], time_chunk("t_us", 3600), {"_held": seen_before(good)}
    )
    base = F.coalesce("_held.score", F.lit(rules.frozen_default))
    pdr = states.stateless_pdr(F.col("net_displacement_m"))
    raised = F.when(pdr == "UNTRACKED_DISPLACEMENT", F.greatest(base, F.lit(75.0))).when(
        pdr == "ZONE_TRANSITION", F.greatest(base, F.lit(40.0))
    ).otherwise(base)
    blind = (F.col("t_us") - F.col("_held.t_us")) / 1e6 > rules.blind_spot_s
    return held.select(
        "user_id",
        "event_id",
        F.when(F.col("is_degraded"), F.round(raised, 2)).otherwise(F.col("score")).alias("risk_score"),
        (F.col("is_degraded") & F.coalesce(blind, F.lit(False))).alias("past_blind_spot"),
    )
