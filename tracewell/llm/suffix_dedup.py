"""Removal of repeated 100-byte strings by deep-shallow suffix sorting.

A byte goes if a ``WINDOW``-byte string that covers it also starts earlier: in a document with a smaller id, or earlier in the
same one.  Sorting all suffixes of a large corpus would move every byte many times over, so suffixes are first dealt into groups
that hold all their equals:

1. Each window has an anchor, the place of the smallest of its ``GRAM``-byte hashes (the first of equal ones).  The anchor depends
   on the window's bytes alone, so equal windows have equal anchor grams at equal distance.  About one byte in 35 is an anchor;
   only anchors are shuffled, each with the range of windows it serves and a hash of the stretch those windows cover.
2. Of anchors with the same gram and the same stretch only the earliest can be first: the windows of all others are repeats.
   Most of them are found before the shuffle, batch by batch, so that a gram of very many copies is not dealt to one task.
   The earliest ones are left to compare only where one gram has several stretches - at the ends of repeated passages.
3. For those the bytes of the stretches are fetched, and all suffixes (cut at ``WINDOW`` bytes) of one gram at one distance are
   sorted: shallow, word by word (eight bytes; one library sort of all segments of a depth, no partition by pivots), down to
   ``SHALLOW`` bytes; and deep, segments with that much in common by blind tries, which branch on single bytes and compare a suffix with one
   leaf only.  Of equal suffixes the earliest stays.

Gram and stretch hashes have 64 bits each; step 2 takes two stretches for equal if both agree, step 3 compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, record, texts
from tracewell.session import store

WINDOW = 100
GRAM = 32
SHALLOW = 32
#: Window starts of a text worked on at a time; positions must fit in the low 24 bits of an anchor key.
STRIDE = 4_000_000
#: Stretches sorted at a time, if their gram groups allow.
SORT_ROWS = 20_000
LAST_ID = 2**63 - 1
ANCHORS = pa.schema([*((n, pa.int64()) for n in ("gram", "stretch", "doc", "alt", "place")), ("again", pa.int32())])
#: Groups over which anchors that are known to repeat are dealt.
SALTS = 997


# ---- anchors -----------------------------------------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place on, by doubling."""
    mul, mix = np.uint64(0xD6E8FEB86659FD93), np.uint64(31)
    h = (raw.astype(np.uint64) + np.uint64(0x1234567)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 1
    while size < GRAM:
        left = h[:-size]
        h = left * mul ^ (h[size:] + (left >> mix))
        size *= 2
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(32)


def anchor_of_windows(hashes: np.ndarray) -> np.ndarray:
    """Place of the smallest hash within each window, the first of equal ones (by their upper 40 bits)."""
    low = np.uint64(0xFFFFFF)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, width = 1, WINDOW - GRAM + 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if width > span:
        key = np.minimum(key[: -(width - span)], key[width - span :])
    return (key & low).astype(np.int64)


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hashes, stretch hashes, places) of the anchors of one text.

    A place holds the position, and the distances from the first and the last window served to it.
    """
    for start in range(0, len(text) - WINDOW + 1, STRIDE):
        part = text[start : start + STRIDE + WINDOW - 1]
        hashes = gram_hashes(np.frombuffer(part, np.uint8))
        at = anchor_of_windows(hashes)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        place = at[first]
        far, near = place - first, place - last
        digest = xxhash.xxh64_intdigest
        stretch = [digest(part[a : b + WINDOW], s) for a, b, s in zip(first.tolist(), last.tolist(), (far << 8 | near).tolist())]
        yield hashes[place].view(np.int64), np.array(stretch, np.uint64).view(np.int64), (place + start) << 16 | far << 8 | near


def _anchor_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    docs, alts = batch.column("doc").to_pylist(), batch.column("alt").to_pylist()
    for doc, alt, text in zip(docs, alts, batch.column("text").cast(pa.binary()).to_pylist()):
        for gram, stretch, place in anchors(text):
            for c, x in zip(columns, (gram, stretch, np.full(len(gram), doc), np.full(len(gram), alt), place)):
                c.append(x)
    if not columns[0]:
        return
    x = np.column_stack([np.concatenate(c) for c in columns])
    x = x[np.lexsort(x.T[::-1])]
    fresh = np.concatenate(([True], (x[1:] != x[:-1]).any(1)))
    x = x[fresh]  # equal rows stem from repeated rows of the input
    # Later ones of a stretch in this batch repeat the first; they only pass through the shuffle, so a group number spreads them.
    again = np.concatenate(([False], (x[1:, :2] == x[:-1, :2]).all(1)))
    yield record(ANCHORS, *x.T, np.where(again, 1 + x[:, 2] % SALTS, 0))


# ---- equal stretches ---------------------------------------------------------------------------------------------------------


def _classes(batches) -> Iterator[pa.RecordBatch]:
    """From anchors in order: rows with ``repeat`` (an earlier anchor has the same stretch) and the earliest of several stretches.

    Only the last row and, while its gram has one stretch, that stretch's earliest row are carried from batch to batch.
    """
    schema = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("alt", pa.int64()), ("place", pa.int64()), ("repeat", pa.bool_())])
    before, alone = None, None  # last row; the earliest row of a gram with one stretch so far
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]])
        known = batch.column("again").to_numpy(zero_copy_only=False) > 0
        if known.any():
            yield record(schema, x[known, 0], x[known, 2], x[known, 3], x[known, 4], np.ones(known.sum(), bool))
            x = x[~known]
        if not len(x):
            continue
        x = x if before is None else np.concatenate((before[None], x))
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x[1:] != x[:-1]).any(1)
        x = x[fresh]  # equal rows stem from repeated rows of the input
        gram = np.concatenate(([before is None], x[1:, 0] != x[:-1, 0]))
        kind = gram | np.concatenate(([before is None], x[1:, 1] != x[:-1, 1]))
        own = np.arange(len(x)) >= (before is not None)
        number = np.cumsum(gram)
        kinds = np.bincount(number, kind, minlength=number[-1] + 1)
        if before is not None and not gram[0]:
            kinds[number[0]] += 1 if alone is not None else 2
        several = (kinds >= 2)[number]
        out = [x[own & ~kind], x[own & kind & several]]
        if alone is not None and kinds[number[0]] >= 2:
            out.insert(1, alone[None])
        flag = np.concatenate([np.full(len(o), k == 0) for k, o in enumerate(out)])
        rows = np.concatenate(out)
        if len(rows):
            yield record(schema, rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 4], flag)
        if kinds[number[-1]] >= 2:
            alone = None
        elif gram.any() and number[-1] != number[0] or alone is None:
            alone = x[np.flatnonzero(number == number[-1])[0]]
        before = x[-1]


# ---- deep-shallow sorting ----------------------------------------------------------------------------------------------------


class BlindTrie:
    """Trie of equally long strings that keeps only where and on which byte its branches part."""

    def __init__(self):
        self.root = None

    def add(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = (text, [item])
            return
        node = self.root
        while isinstance(node, list):  # down to any leaf: the skipped bytes are not looked at
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        if node[0] == text:
            node[1].append(item)
            return
        apart = int.from_bytes(text) ^ int.from_bytes(node[0])
        depth = len(text) - (apart.bit_length() + 7) // 8
        other = node[0][depth]
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][text[depth]] = (text, [item])
            return
        branch = [depth, {other: node, text[depth]: (text, [item])}]
        if above is None:
            self.root = branch
        else:
            above[1][text[above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Items of each distinct string, in the order of the strings."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node[1]


def equal_suffixes(data: bytes, starts: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """For each suffix (its place in ``data``, cut at WINDOW bytes) the first of its equals in the same segment, by index.

    ``segments`` must not decrease.  A stretch never ends before WINDOW bytes of its suffixes.
    """
    first = np.arange(len(starts))
    padded = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint64)
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(data)] << np.uint64(8 * (7 - k))
    order, segment = np.arange(len(starts)), segments
    for depth in range(0, SHALLOW, 8):
        # Suffixes alone in their segment are in place.
        same = segment[1:] == segment[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        order, segment = order[many], segment[many]
        if not len(order):
            return first
        word = words[starts[order] + depth]
        apart = (segment[1:] == segment[:-1]) & (word[1:] != word[:-1])
        mixed = np.isin(segment, segment[1:][apart])
        rows = np.flatnonzero(mixed)
        turn = rows[np.lexsort((word[rows], segment[rows]))]
        order[rows], word[rows] = order[turn], word[turn]
        segment = np.cumsum(np.concatenate(([False], (segment[1:] != segment[:-1]) | (word[1:] != word[:-1]))))
    edge = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True])))
    size = np.diff(edge)
    # A trie of two leaves is one comparison.
    a, b = order[edge[:-1][size == 2]], order[edge[:-1][size == 2] + 1]
    equal = np.ones(len(a), bool)
    for depth in [*range(SHALLOW, WINDOW - 8, 8), WINDOW - 8]:
        equal &= words[starts[a] + depth] == words[starts[b] + depth]
    low, high = np.minimum(a, b)[equal], np.maximum(a, b)[equal]
    first[high] = low
    for k in np.flatnonzero(size > 2).tolist():
        trie = BlindTrie()
        for i in order[edge[k] : edge[k + 1]].tolist():
            at = starts[i]
            trie.add(data[at + SHALLOW : at + WINDOW], i)
        for items in trie.leaves():
            if len(items) > 1:
                first[items] = min(items)
    return first


def _repeats(x: np.ndarray, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte behind the last) of runs of repeated windows among whole gram groups.

    ``x`` has the columns gram, doc, alt, place and is in that order.
    """
    far, near = x[:, 3] >> 8 & 255, x[:, 3] & 255
    n = far - near + 1
    row = np.repeat(np.arange(len(x)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum([0, *map(len, stretches)])[:-1]
    distance = far[row] - step
    group = np.cumsum(np.concatenate(([True], x[1:, 0] != x[:-1, 0])))[row]
    order = np.lexsort((row, distance, group))
    segment = np.cumsum(np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (distance[order][1:] != distance[order][:-1]))))
    first = equal_suffixes(b"".join(stretches), (begin[row] + step)[order], segment)
    again = np.zeros(len(row), bool)
    again[order] = first != np.arange(len(row))
    hit = np.flatnonzero(again)
    place = (x[row[hit], 3] >> 16) - distance[hit]
    new = np.concatenate(([True], (row[hit][1:] != row[hit][:-1]) | (place[1:] != place[:-1] + 1))) if len(hit) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    stop = np.concatenate((start[1:], [len(hit)])) - 1 if len(hit) else start
    return row[hit][start], place[start], place[stop] + WINDOW


def _sort_stretches(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64()) for n in ("doc", "alt", "start", "stop")])
    rows, stretches = np.zeros((0, 4), np.int64), []

    def flush(k):
        x, own = rows[:k], stretches[:k]
        fresh = np.concatenate(([True], (x[1:] != x[:-1]).any(1)))
        x, own = x[fresh], [s for s, f in zip(own, fresh) if f]
        row, start, stop = _repeats(x, own)
        return record(schema, x[row, 1], x[row, 2], start, stop)

    for batch in batches:
        rows = np.concatenate((rows, np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("gram", "doc", "alt", "place")])))
        stretches += batch.column("bytes").to_pylist()
        if len(rows) >= SORT_ROWS:
            k = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last gram may go on
            if k:
                yield flush(k)
                rows, stretches = rows[k:], stretches[k:]
    if len(rows):
        yield flush(len(rows))


# ---- the operator ------------------------------------------------------------------------------------------------------------


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``docs`` as doc, alt, doc_id, text; runs doc, alt, start, stop of repeated windows, not merged)."""
    own = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    # Ids that occur once need no second key; the check moves nothing but ids.
    again = not own.groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = own.select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"),
        # Always zero without repeated ids, but no literal: a constant would be taken out of the join keys, and with it the chance
        # that both joins below read one shuffle of the texts.
        (F.xxhash64("text") if again else F.least(F.octet_length("text"), F.lit(0)).cast("long")).alias("alt"),
        "doc_id",
        "text",
    )
    long_enough = keyed.where(F.octet_length("text") >= WINDOW)
    found = map_batches(long_enough.select("doc", "alt", "text"), _anchor_rows, "gram long, stretch long, doc long, alt long, place long, again int")
    dealt = found.repartition("gram", "again").sortWithinPartitions("gram", "stretch", "doc", "alt", "place")
    classes = store(dealt.mapInArrow(_classes, "gram long, doc long, alt long, place long, repeat boolean"))
    position, far, near = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    whole = classes.where("repeat").select("doc", "alt", (position - far).alias("start"), (position - near + WINDOW).alias("stop"))

    wanted = classes.where("not repeat").groupBy("doc", "alt").agg(F.collect_list(F.struct("gram", "place")).alias("wanted"))

    def fetch(batch):
        schema = pa.schema([*((n, pa.int64()) for n in ("gram", "doc", "alt", "place")), ("bytes", pa.binary())])
        keys = zip(batch.column("doc").to_pylist(), batch.column("alt").to_pylist())
        for (doc, alt), text, asked in zip(keys, batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted")):
            gram, place = (asked.values.field(k).to_numpy() for k in (0, 1))
            at, far, near = place >> 16, place >> 8 & 255, place & 255
            cut = [text[a:b] for a, b in zip((at - far).tolist(), (at - near + WINDOW).tolist())]
            yield record(schema, gram, np.full(len(gram), doc), np.full(len(gram), alt), place, cut)

    stretches = map_batches(keyed.join(wanted, ["doc", "alt"]), fetch, "gram long, doc long, alt long, place long, bytes binary")
    sorted_ = stretches.repartition("gram").sortWithinPartitions("gram", "doc", "alt", "place")
    return keyed, whole.unionByName(sorted_.mapInArrow(_sort_stretches, "doc long, alt long, start long, stop long"))


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges; ranges that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return starts[at], reach[np.concatenate((at[1:], [len(starts)])) - 1]


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``docs``; with ``keep_text`` also ``kept`` (bytes).

    Texts are taken as UTF-8 bytes, a null text as empty.  A null ``doc_id`` counts as larger than all others.  Different texts
    under one id are ordered by a hash of the text; rows that repeat both id and text are one document and all get its result.
    An empty table gives no rows; other columns are ignored.
    """
    keyed, runs = repeated_runs(docs)
    spans = runs.groupBy("doc", "alt").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
        *([("kept", pa.binary())] if keep_text else []),
    ])

    def cut(batch):
        out = []
        for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs")):
            kept, starts, stops = text, (), ()
            if runs.is_valid:
                starts, stops = merged(*(runs.values.field(k).to_numpy() for k in (0, 1)))
                kept = b"".join(text[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(text)]))
            out.append((len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
        yield record(schema, batch.column("doc_id"), *zip(*out))

    return map_batches(keyed.join(spans, ["doc", "alt"], "left"), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
