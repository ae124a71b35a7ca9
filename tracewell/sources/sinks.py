"""Tables a stream writes: append per batch, and keyed merges in hash buckets behind a version pointer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a merged table.  A batch rewrites those its keys fall in.
BUCKETS = 64


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch under its own id, so a repeated batch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def latest_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert or update: the newest row per key over both tables; combined before the shuffle."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    ).select(*keys, "_r.*")


def merge_batch(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Merge a micro-batch into the keyed table at ``path``; the newest row of a key wins."""
    newest = latest_wins(batch.limit(0), batch, keys, order)
    merge_buckets(newest, batch_id, path, keys, lambda old, new: latest_wins(old, new, keys, order))


def merge_buckets(
    batch: DataFrame, batch_id: int, path: str, keys: Sequence[str],
    combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS,
) -> None:
    """Merge ``batch`` (one row per key) into the table at ``path``; ``combine(old, new)`` makes one row per key of both.

    Rows lie in hash buckets.  Only buckets that the batch touches are read and written, as a new version; a pointer names the
    version of every bucket and is written last, so readers see whole batches.  A batch always starts from the newest pointer before
    it, so a repeated one gives the same table.  What neither this pointer nor the one before names is deleted.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    rows.persist()
    try:
        touched = sorted(r._bucket for r in rows.select("_bucket").distinct().collect())
        before = max((v for v in _versions(spark, f"{path}/pointer") if v < batch_id), default=None)
        held = _pointer(spark, path, before)
        old = [_bucket_path(path, b, held[b]) for b in touched if b in held]
        new = rows.drop("_bucket")
        if touched:
            merged = combine(spark.read.schema(new.schema).parquet(*old) if old else new.limit(0), new)
            marked = merged.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            marked.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v={batch_id}")
        now = held | {b: batch_id for b in touched}
        pointer = spark.createDataFrame(sorted(now.items()), "bucket int, version bigint")
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer/v={batch_id}")
        _clean(spark, path, batch_id, before, set(now.items()) | set(held.items()))
    finally:
        rows.unpersist()


def read_merged(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """The merged table at its newest version, or as batch ``batch_id`` left it if that is the newest or the one before."""
    versions = _versions(spark, f"{path}/pointer")
    chosen = max(versions) if batch_id is None else batch_id
    held = _pointer(spark, path, chosen)
    return spark.read.parquet(*[_bucket_path(path, b, v) for b, v in held.items()])


def _bucket_path(path: str, bucket: int, version: int) -> str:
    return f"{path}/data/v={version}/_bucket={bucket}"


def _pointer(spark: SparkSession, path: str, version: int | None) -> dict[int, int]:
    if version is None:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version bigint").parquet(f"{path}/pointer/v={version}").collect()}


def _folder(spark: SparkSession, path: str):
    """File system and path object of a folder, by whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, target = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose write was finished."""
    fs, _ = _folder(spark, path)
    done = lambda v: fs.exists(_folder(spark, f"{path}/v={v}/_SUCCESS")[1])
    return [v for v in _children(spark, path, "v=") if done(v)]


def _clean(spark: SparkSession, path: str, batch_id: int, before: int | None, named: set[tuple[int, int]]) -> None:
    fs, _ = _folder(spark, path)
    for v in _children(spark, f"{path}/data", "v="):
        buckets = _children(spark, f"{path}/data/v={v}", "_bucket=")
        gone = [b for b in buckets if v < batch_id and (b, v) not in named]
        paths = [f"{path}/data/v={v}"] if len(gone) == len(buckets) and v < batch_id else [_bucket_path(path, b, v) for b in gone]
        for p in paths:
            fs.delete(_folder(spark, p)[1], True)
    for v in _children(spark, f"{path}/pointer", "v="):
        if v < batch_id and v != before:
            fs.delete(_folder(spark, f"{path}/pointer/v={v}")[1], True)
