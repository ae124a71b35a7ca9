"""Finite state machines over ordered readings, split so that one key can span many tasks.

A machine is a Python transition function over small integers.  The streaming handlers call it
directly.  The batch form sorts readings over range partitions, which cut a key by count wherever it
is too large for one, and walks each partition row by row.  Only the first key of a partition can
have begun earlier; its rows carry a state-to-state map in place of a state.  One row per partition
tells the state each was entered in, and the maps are read at that state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import store


@dataclass(frozen=True)
class Machine:
    states: tuple[str, ...]
    symbols: int
    step: Callable[[int, int], int]
    start: int = 0

    def table(self) -> list[int]:
        return [
            self.step(s, x) for s in range(len(self.states)) for x in range(self.symbols)
        ]

    def name(self, state: Column) -> Column:
        names = F.array(*[F.lit(n) for n in self.states])
        # Stated, as element_at over constants is never taken to be null.
        return F.when(state.isNotNull(), F.element_at(names, state + 1))


class _Walk:
    """Walks maps (tuples of states) instead of states; a map is met again as its number."""

    def __init__(self, table: list[int], width: int):
        self.table, self.width = table, width
        self.maps: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.moves: dict[tuple[int, int], int] = {}

    def number(self, states: tuple[int, ...]) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.maps)
            self.maps.append(states)
        return self.numbers[states]

    def move(self, at: int, symbol: int) -> int:
        if (at, symbol) not in self.moves:
            after = tuple(self.table[s * self.width + symbol] for s in self.maps[at])
            self.moves[at, symbol] = self.number(after)
        return self.moves[at, symbol]


def _walker(columns: list[str], keys: list[str], machine: Machine) -> Callable:
    table, width, states, start = machine.table(), machine.symbols, len(machine.states), machine.start

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, first, key = TaskContext.get().partitionId(), 0, True, None
        lane = _Walk(table, width)
        at = lane.number(tuple(range(states)))
        fresh = lane.number((start,))
        for batch in batches:
            inputs = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "_chunk", "_symbol")]
            before, after, leading = [], [], []
            for *here, chunk, symbol in zip(*inputs):
                if chunk is None or symbol is None or None in here:
                    before.append(None)
                    after.append(None)
                    leading.append(False)
                    continue
                if key is not None and here != key:
                    first, at = False, fresh
                key = here
                before.append(at)
                leading.append(first)
                at = lane.move(at, symbol)
                after.append(at)
            maps = pa.array(lane.maps, pa.list_(pa.int16()))
            size = batch.num_rows
            added = [
                pa.array([part] * size, pa.int32()),
                pa.array(range(seen, seen + size), pa.int64()),
                pa.array(leading, pa.bool_()),
                maps.take(pa.array(before, pa.int64())),
                maps.take(pa.array(after, pa.int64())),
            ]
            seen += size
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *added], [*columns, "_part", "_n", "_leading", "_before", "_after"])

    return walk


def run_machine(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    symbol: Column,
    machine: Machine,
) -> DataFrame:
    """Add ``state_before`` and ``state_after`` (names) to every reading.

    ``chunk`` must not decrease along ``order``.  A reading without a key, a chunk (a time) or a
    symbol moves no machine and stays with null states, so that it can be counted.
    """
    keys = list(keys)
    spark = df.sparkSession
    body = [c for c in df.columns if c != "_chunk"]
    rows = (df if "_chunk" in df.columns else df.withColumn("_chunk", chunk)).withColumn("_symbol", symbol.cast("int"))
    place = [*keys, "_chunk", *order]
    # A stated number, so that no partition is merged or split after its place is set.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, *place).sortWithinPartitions(*place)
    states = T.ArrayType(T.ShortType())
    added = [("_part", T.IntegerType()), ("_n", T.LongType()), ("_leading", T.BooleanType()), ("_before", states), ("_after", states)]
    schema = T.StructType([*laid.select(*body).schema.fields, *(T.StructField(n, t) for n, t in added)])
    walked = store(laid.mapInArrow(_walker(body, keys, machine), schema))
    entries = spark.createDataFrame(_entered(walked, keys, machine), "_part int, _entry int")  # one row per partition
    entry = F.when(F.col("_leading"), F.coalesce("_entry", F.lit(machine.start))).otherwise(0)
    named = [machine.name(F.get(c, entry)).alias(n) for c, n in (("_before", "state_before"), ("_after", "state_after"))]
    return walked.join(F.broadcast(entries), "_part", "left").select(*body, *named)


def _entered(walked: DataFrame, keys: list[str], machine: Machine) -> list[tuple[int, int]]:
    """Partitions whose first key began in an earlier one, with the state it comes in.

    One row per partition, whatever the number of readings, reaches the driver.
    """
    key = F.struct(*keys)
    ends = (
        walked.where(F.col("_before").isNotNull())
        .groupBy("_part")
        .agg(
            F.min_by(key, "_n").alias("head"),
            F.max_by(F.struct(key.alias("key"), "_leading", "_after"), "_n").alias("tail"),
        )
        .orderBy("_part")
        .collect()
    )
    out, last, state = [], None, machine.start
    for end in ends:
        entry = state if end["head"] == last else machine.start
        if end["head"] == last:
            out.append((end["_part"], entry))
        tail = end["tail"]
        last, state = tail["key"], tail["_after"][entry if tail["_leading"] else 0]
    return out
