"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task works on at a time.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (string) and the named columns; all other columns are left behind, so none can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the ``text`` column of each has about ``most`` bytes at most (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.nbytes <= most:
            yield batch
            continue
        size = max(1, int(n * most / batch.nbytes))
        for at in range(0, n, size):
            part = batch.slice(at, min(size, n - at))
            yield part


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over slices of bounded size, in the tasks that read ``df``."""

    def run(batches):
        for part in slices(batches):
            yield from fn(part)

    return df.mapInArrow(run, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
