"""Trace files: one text file per trip, a fixed header, then seven comma fields per fix."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.config import CleaningRules
from tracewell.session import store

# Fixed patterns: <user>/Trajectory/<trip>.plt or <user>/<trip>.plt
USER_PATTERN = r"([^/]+)/(?:[Tt]rajectory/)?[^/]+\.plt$"
TRIP_PATTERN = r"([^/]+)\.plt$"
STAMP_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


#: Files up to this size are read whole, each by one task; larger ones in blocks.
WHOLE_BYTES = 32 << 20


def discover(spark: SparkSession, root: str) -> DataFrame:
    """User, trip and path of every trace file below ``root``."""
    return _named(_listed(spark, root), F.col("path")).select("user_id", "trajectory_id", "path", "length")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of every trace file below ``root``.

    Spark's readers list all files on the driver.  Here folders are rows: those of two levels are spread over tasks, which list what
    is below them.  A root that only Spark can open (a scheme of its own, a pattern, one file) goes by its reader.
    """
    if _folder(root) is None:
        traces = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.plt")
        return traces.load(root).select("path", "length")
    rows, parts = spark.range(0, 1, 1, 1).select(F.lit(root).alias("path"), F.lit(None).cast("bigint").alias("length")), 1
    for deep in (False, False, True):
        rows = rows.repartition(parts, "path").mapInArrow(_lister(root, deep), "path string, length bigint")
        parts = 4 * spark.sparkContext.defaultParallelism
    return rows


def _folder(root: str) -> tuple[fs.FileSystem, str] | None:
    """File system and path of a folder, null if it is none or of an unknown kind."""
    try:
        files, base = fs.FileSystem.from_uri(root)
        return (files, base) if files.get_file_info(base).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def _lister(root: str, deep: bool):
    """Puts what a folder holds in the place of its row; hidden names are left out, as Spark does."""
    hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                if length is not None:
                    yield pa.RecordBatch.from_pydict({"path": [path], "length": pa.array([length], pa.int64())})
                    continue
                above = base + path[len(root):]
                found = []
                for info in files.get_file_info(fs.FileSelector(above, recursive=deep)):
                    below = info.path[len(above):].strip("/")
                    if any(map(hidden, below.split("/"))):
                        continue
                    if info.type == fs.FileType.Directory and not deep:
                        found.append((f"{path.rstrip('/')}/{below}", None))
                    elif info.type == fs.FileType.File and below.endswith(".plt"):
                        found.append((f"{path.rstrip('/')}/{below}", info.size))
                paths, lengths = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "length": pa.array(lengths, pa.int64())})

    return listing


def _named(df: DataFrame, path: Column) -> DataFrame:
    user = F.regexp_extract(path, USER_PATTERN, 1)
    return df.withColumn("user_id", user).withColumn(
        "trajectory_id", F.concat_ws("_", user, F.regexp_extract(path, TRIP_PATTERN, 1))
    )


def read_traces(
    spark: SparkSession, root: str, rules: CleaningRules = CleaningRules()
) -> DataFrame:
    """Raw fixes with their line number in the file; rows without seven typed fields are dropped.

    Files of up to ``WHOLE_BYTES`` are dealt over the tasks by their listing and read whole; larger ones in blocks.
    """
    if _folder(root) is None:
        placed = _in_blocks(spark, root)
    else:
        listed = store(_listed(spark, root))
        size, large = listed.agg(F.sum("length"), F.count_if(F.col("length") > WHOLE_BYTES)).first()
        parts = max(4 * spark.sparkContext.defaultParallelism, (size or 0) // WHOLE_BYTES)
        small = listed.where(F.col("length") <= WHOLE_BYTES).select("path").repartition(parts, "path")
        whole = small.mapInArrow(_whole(root), "path string, pos bigint, line binary")
        placed = whole.withColumn("line", F.col("line").cast("string"))
        if large:
            paths = [r.path for r in listed.where(F.col("length") > WHOLE_BYTES).select("path").collect()]
            placed = placed.unionByName(_in_blocks(spark, paths))
    lines = _named(placed, F.col("path")).select("user_id", "trajectory_id", "pos", "line")
    f = F.split("line", ",")
    stamp = F.concat_ws(" ", F.trim(f[5]), F.trim(f[6]))
    fields = (
        lines.where((F.col("pos") >= rules.header_lines) & (F.length(F.trim("line")) > 0))
        .where(F.size(f) == 7)
        .select(
            "user_id",
            "trajectory_id",
            "pos",
            F.when(stamp.rlike(STAMP_PATTERN), stamp.try_cast("timestamp_ntz")).alias("timestamp"),
            f[0].try_cast("double").alias("latitude"),
            f[1].try_cast("double").alias("longitude"),
            f[2].try_cast("bigint").alias("_reserved"),
            f[3].try_cast("double").alias("altitude"),
            f[4].try_cast("double").alias("raw_days"),
            F.trim(f[5]).alias("date_str"),
            F.trim(f[6]).alias("time_str"),
        )
    )
    numeric = ["latitude", "longitude", "_reserved", "altitude", "raw_days"]
    return fields.dropna(subset=numeric).drop("_reserved")


def _in_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, pos, line`` of trace files that several tasks read in blocks.

    A line's number is its place in the block plus the lines of the blocks before it; both follow from one row per block, so no file
    is gathered and no line is sorted.
    """
    scanned = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.plt")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"),
        )
    )
    # Rows of a block are numbered one after the other within their task.
    blocks = scanned.groupBy("path", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_lines"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_shift", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).drop("_first", "_lines")
    placed = scanned.join(offsets, ["path", "_block"]).withColumn("pos", F.col("_row") + F.col("_shift"))
    return placed.select("path", "pos", "line")


def _whole(root: str):
    """Numbered lines of whole files; lines end as they do for Spark's text reader."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        paths, places, lines = [], [], []

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"path": paths, "pos": pa.array(places, pa.int64()), "line": pa.array(lines, pa.binary())})
            for part in (paths, places, lines):
                part.clear()
            return out

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(base + path[len(root):], compression=None) as f:
                    found = f.read().removeprefix(b"\xef\xbb\xbf").splitlines()
                for n in range(0, len(found), 10_000):
                    part = found[n:n + 10_000]
                    paths += [path] * len(part)
                    places += range(n, n + len(part))
                    lines += part
                    if len(lines) >= 10_000:
                        yield taken()
        if lines:
            yield taken()

    return read


def write_traces(points: DataFrame, root: str, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Write one trace file per trip below ``root`` and return ``path, fixes`` of each.

    Needs ``user_id, trajectory_id, pos, timestamp, latitude, longitude, altitude`` (feet); lines go by ``pos``, nulls are empty fields.
    A task has one file open at a time, whatever its length; a file appears under its name only when it is complete, so a repeated
    task replaces it with the same lines.
    """
    trip = F.substr(F.col("trajectory_id"), F.length("user_id") + 2)
    days = F.unix_micros(F.col("timestamp").cast("timestamp")) / 86_400e6 + 25_569
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fields = [
        text(F.col("latitude")), text(F.col("longitude")), F.lit("0"), text(F.col("altitude")), text(F.coalesce(days, F.lit(0.0))),
        text(F.date_format("timestamp", "yyyy-MM-dd")), text(F.date_format("timestamp", "HH:mm:ss")),
    ]
    lines = points.select(
        F.concat_ws("/", "user_id", F.lit("Trajectory"), F.concat(trip, F.lit(".plt"))).alias("path"), "pos",
        F.concat_ws(",", *fields).alias("line"),
    )
    laid = lines.repartition("path").sortWithinPartitions("path", "pos")
    return store(laid.mapInArrow(_writer(root, rules.header_lines), "path string, fixes bigint"))


def _writer(root: str, header_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        attempt = TaskContext.get().taskAttemptId()
        path = out = None
        fixes, written = 0, []

        def close() -> None:
            out.close()
            files.move(f"{base}/{path}.{attempt}", f"{base}/{path}")
            written.append((path, fixes))

        def taken() -> pa.RecordBatch:
            paths, counts = zip(*written)
            written.clear()
            return pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "fixes": pa.array(counts, pa.int64())})

        for batch in batches:
            for here, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()):
                if here != path:
                    if out is not None:
                        close()
                    path, fixes = here, 0
                    files.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(f"{base}/{path}.{attempt}")
                    out.write(b"header\r\n" * header_lines)
                out.write(f"{line}\r\n".encode())
                fixes += 1
            if written:
                yield taken()
        if out is not None:
            close()
            yield taken()

    return write


def altitude_metres(feet, rules: CleaningRules = CleaningRules()) -> Column:
    """Feet to metres with one decimal; the missing marker becomes null."""
    feet = F.col(feet) if isinstance(feet, str) else feet
    return F.when(feet != rules.missing_altitude_ft, F.round(feet * 0.3048, 1))
