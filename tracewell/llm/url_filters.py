"""URL filters by temporal list join.

A list is a log of dated entries: a pattern is added or removed on a list at some time.  Per (list, pattern) the entries become
validity intervals ``[valid_from, valid_to)``; a second addition of a listed pattern and a removal of an unlisted one change
nothing, and of entries with the same time the removal comes last.  A capture has one key for each pattern that could cover it:
its host, the parent domains of at least two labels, and host plus each leading part of the path.  An as-of join finds for each
distinct (key, time of fetch) how many intervals hold at that time: interval starts count +1 and ends -1 in time order, and the
running sum up to the fetch is the number of active entries.

Both ordered passes run over slices of time (``functions/scan.py``), so neither a pattern with very many entries nor a domain that
holds a third of all captures is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scan import ordered_scan, previous, running_sum, time_chunk

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
#: Width of a slice of time.
SLICE_SECONDS = 7 * 86_400


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def keys_of(url: Column) -> Column:
    """Every pattern that covers the URL: ``host``, parent domains, ``host/first/second...``."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))
    )
    return F.when(host != "", F.array_distinct(F.concat(parents, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, valid_from, valid_to`` (null: still listed) from ``entries(list, pattern, action, at)``.

    ``action`` is ``add`` or ``remove``; rows with another action, without pattern or without time are left out.  A null list is a
    list of its own.  Patterns are compared in lower case up to the first slash.
    """
    host, path = F.substring_index("pattern", "/", 1), F.expr("substr(pattern, length(substring_index(pattern, '/', 1)) + 1)")
    log = entries.where("pattern is not null and at is not null and action in ('add', 'remove')").select(
        F.coalesce(F.col("list"), F.lit("")).alias("list"),
        F.concat(F.lower(host), path).alias("pattern"),
        (F.col("action") == "add").alias("adds"),
        F.unix_micros(F.col("at").cast("timestamp")).alias("us"),
    )
    # A removal hides an addition at the same time.
    log = log.groupBy("list", "pattern", "us").agg(F.min("adds").alias("adds"))
    key, slice_ = ["list", "pattern"], time_chunk("us", SLICE_SECONDS)
    seen = ordered_scan(log, key, ["us"], slice_, {"before": previous(F.col("adds"))})
    changes = seen.where(F.col("adds") != F.coalesce("before", F.lit(False))).drop("before").withColumn("back", -F.col("us"))
    ends = ordered_scan(changes, key, ["back"], time_chunk("back", SLICE_SECONDS), {"next": previous(F.col("us"))})
    return ends.where("adds").select(
        *key, F.timestamp_micros("us").alias("valid_from"), F.timestamp_micros("next").alias("valid_to")
    )


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with ``n_active`` (entries active on the URL when it was fetched), ``matched`` (the longest pattern of them,
    the first by name of equally long ones) and ``blocked``.

    ``captures`` needs ``url`` and ``fetched``; its other columns stay, but for ones of the three new names.  A null or hostless
    URL and a null time match nothing.  Repeated captures give repeated results; an empty list blocks nothing.
    """
    plain = captures.drop("n_active", "matched", "blocked")
    key = F.struct(F.col("url").alias("url"), F.unix_micros(F.col("fetched").cast("timestamp")).alias("us"))
    distinct = plain.select(key.alias("k")).where("k.url is not null and k.us is not null").distinct().select("k.url", "k.us")
    asked = distinct.select("url", "us", F.explode(keys_of(F.col("url"))).alias("pattern"))
    spans = intervals(entries)
    moves = spans.select("pattern", F.unix_micros("valid_from").alias("us"), F.lit(1).alias("move")).unionByName(
        spans.where("valid_to is not null").select("pattern", F.unix_micros("valid_to").alias("us"), F.lit(-1).alias("move"))
    )
    moves = moves.groupBy("pattern", "us").agg(F.sum("move").alias("move"))
    times = asked.select("pattern", "us").distinct()
    # Moves come before the captures of the same time.
    line = moves.select("pattern", "us", F.lit(0).alias("kind"), "move").unionByName(
        times.select("pattern", "us", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("move"))
    )
    counted = ordered_scan(line, ["pattern"], ["us", "kind"], time_chunk("us", SLICE_SECONDS), {"active": running_sum(F.col("move"))})
    active = counted.where("kind = 1 and active > 0").select("pattern", "us", "active")
    found = asked.join(active, ["pattern", "us"]).groupBy("url", "us").agg(
        F.sum("active").cast("long").alias("n_active"),
        F.min_by("pattern", F.struct(-F.length("pattern"), F.col("pattern"))).alias("matched"),
    )
    found = found.select(F.struct("url", "us").alias("_k"), "n_active", "matched")
    names = [F.col(f"`{c}`") for c in plain.columns]
    joined = plain.select(F.struct(*names).alias("row"), key.alias("k")).join(found, F.col("k") == F.col("_k"), "left")
    return joined.select(
        *[F.col("row")[c].alias(c) for c in plain.columns],
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        "matched",
        F.col("matched").isNotNull().alias("blocked"),
    )
