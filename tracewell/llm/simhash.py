"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code: two binary Golay codes side by side, over the lowest 46 of the 64 bits.  A Golay
code is perfect with covering radius 3, so every 23-bit half has exactly one codeword within 3 bits.  Two fingerprints at most t
bits apart have a point between them that is at most ceil(t / 2) bits from either; the anchor next to that point is within the
covering radius plus ceil(t / 2) of both.  So each fingerprint is copied to every anchor whose excess over the radius, added over
the two halves, is at most ceil(t / 2) - 61 copies on average for t = 3, spread over 2**24 anchors - and pairs are compared, over
all 64 bits, only where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, record, texts
from tracewell.llm.graph import components
from tracewell.session import store

SEED = 42
SHINGLE = 3
THRESHOLD = 3
HALF, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
BLOCK = 65_536
#: Anchors with more fingerprints are searched outward from one fingerprint, smaller ones in one pass over all of a batch.
WIDE = 32


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a text: A-Z lowered, words between ASCII blanks, three-word shingles; 0 without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batch):
        yield record(schema, batch.column("doc_id"), [fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()])

    return map_batches(texts(docs), run, "doc_id long, fp long")


@lru_cache(maxsize=4)
def _cosets(excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns up to weight RADIUS + excess by syndrome: (first index of each syndrome, patterns, excess of each)."""
    weights = range(RADIUS + excess + 1)
    errors = [(sum(1 << b for b in bits), max(0, w - RADIUS)) for w in weights for bits in combinations(range(HALF), w)]
    words = np.array([e for e, _ in errors], np.int64)
    over = np.array([x for _, x in errors], np.int64)
    of = syndrome(words)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(2 ** (HALF - 12) + 1))
    return first, words[order], over[order]


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.copy()
    for bit in range(HALF - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _near(half: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, codeword, excess) for each codeword within RADIUS + excess of each value."""
    first, words, over = _cosets(excess)
    s = syndrome(half)
    n = first[s + 1] - first[s]
    row = np.repeat(np.arange(len(half)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s], n)
    return row, half[row] ^ words[at], over[at]


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor that each fingerprint is copied to."""
    excess = -(-threshold // 2)
    mask = (1 << HALF) - 1
    low_row, low, low_over = _near(fps & mask, excess)
    high_row, high, high_over = _near(fps >> HALF & mask, excess)
    # All combinations of the two lists of one row.
    n = np.bincount(high_row, minlength=len(fps))
    start = np.cumsum(n) - n
    repeat = n[low_row]
    left = np.repeat(np.arange(len(low_row)), repeat)
    right = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(start[low_row], repeat)
    keep = low_over[left] + high_over[right] <= excess
    left, right = left[keep], right[keep]
    return low_row[left], high[right] << HALF | low[left]


def _apart(x: np.ndarray) -> np.ndarray:
    """Set bits of each value (numpy counts those of the absolute value, so the sign must go first)."""
    return np.bitwise_count(x.view(np.uint64))


def _spread(group: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Spanning links of one large group: walk outward from a fingerprint over those not yet reached."""
    rest = group
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            close = _apart(rest ^ one) <= threshold
            for other in rest[close].tolist():
                yield int(one), other
            todo.extend(rest[close])
            rest = rest[~close]


def _links(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """Links inside the groups of equal ``anchor`` (sorted): all pairs in reach for small groups, spanning ones for large."""
    edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    size = np.diff(edge)
    a, b = [], []
    small = np.repeat(size <= WIDE, size)
    where = np.flatnonzero(small & np.repeat(size > 1, size))
    key, value = anchor[where], fp[where]
    for step in range(1, min(WIDE, len(where))):
        same = key[step:] == key[:-step]
        if not same.any():
            break
        hit = np.flatnonzero(same & (_apart(value[step:] ^ value[:-step]) <= threshold))
        a.extend(value[hit].tolist())
        b.extend(value[hit + step].tolist())
    for g in np.flatnonzero(size > WIDE):
        for x, y in _spread(fp[edge[g] : edge[g + 1]], threshold):
            a.append(x)
            b.append(y)
    return a, b


def fingerprint_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints (column ``fp``) that connect all pairs within ``threshold`` bits."""
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def copy(batches):
        schema = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                row, anchor = anchors(part, threshold)
                yield record(schema, anchor, part[row])

    def compare(batches):
        key = value = np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate((key, batch.column("anchor").to_numpy(zero_copy_only=False)))
            value = np.concatenate((value, batch.column("fp").to_numpy(zero_copy_only=False)))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            yield record(pair, *_links(key[:last], value[:last], threshold))
            key, value = key[last:], value[last:]
        if len(key):
            yield record(pair, *_links(key, value, threshold))

    copies = distinct.select("fp").mapInArrow(copy, "anchor long, fp long")
    met = copies.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return met.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs``.

    Equal fingerprints are one class before any comparison, so copies cost nothing; classes are linked at ``threshold`` or fewer
    differing bits, and ``component_id`` is the smallest ``doc_id`` that links reach.  A null or blank text has fingerprint zero
    and is linked like any other.  Repeated rows give repeated results.  A null ``doc_id`` stays null and never is a component's
    smallest (a component of nothing else has a null ``component_id``).  An empty table gives no rows; other columns are ignored.
    """
    fps = store(fingerprints(docs))
    classes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = store(components(fingerprint_links(classes, threshold)).join(classes.withColumnRenamed("fp", "node"), "node"))
    roots = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = linked.join(roots, "root").select(F.col("node").alias("fp"), "component_id")
    named = classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of its smallest ``doc_id`` stays, once.

    Rows without ``doc_id`` are left as they are: nothing names them.
    """
    kept = near_duplicates(docs, threshold).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
