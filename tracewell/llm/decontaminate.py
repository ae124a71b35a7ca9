"""Benchmark decontamination by pigeonhole edit matching.

An item is found in a document if some stretch of the document is within ``len(item) // per_error`` edits of it (characters of
both lower-cased, blanks run together).  With a budget of k edits, an item is cut into k + 1 pieces; k edits cannot touch all of
them, so a stretch within the budget holds one piece unchanged, at nearly its place.  All pieces are searched at once by an
Aho-Corasick automaton; the stretches around hits are screened by a count of shared three-grams, which loses none within the
budget, and verified with Myers' bit-parallel edit distance.

The items go to the tasks in blocks of about ``block_chars`` characters; every block is matched against all documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, record, slices, texts

GRAM = 3
_SEARCHERS: dict[tuple, Searcher] = {}


@dataclass(frozen=True)
class MatchRules:
    per_error: int = 10
    block_chars: int = 4_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


class Pattern:
    """One item: its budget and what the distance needs."""

    def __init__(self, text: str, per_error: int):
        self.text, self.size, self.budget = text, len(text), len(text) // per_error
        self.bits: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.bits[c] |= 1 << i
        self.bits.default_factory = None
        self.grams = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}

    def pieces(self) -> Iterator[tuple[int, str]]:
        """(offset, piece) of the budget + 1 pieces, as even as can be."""
        n = self.budget + 1
        cuts = [self.size * j // n for j in range(n + 1)]
        for a, b in zip(cuts, cuts[1:]):
            yield a, self.text[a:b]

    def plausible(self, stretch: str) -> bool:
        """One edit removes GRAM distinct three-grams at most."""
        need = len(self.grams) - GRAM * self.budget
        if need <= 0:
            return True
        return len(self.grams & {stretch[i : i + GRAM] for i in range(len(stretch) - GRAM + 1)}) >= need

    def distance(self, stretch: str) -> int:
        """Least edits between the item and any part of ``stretch``."""
        get, full, high = self.bits.get, (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, best = full, 0, self.size, self.size
        for c in stretch:
            same = get(c, 0)
            vertical = same | minus
            across = (((same & plus) + plus) ^ plus) | same
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & high:
                score += 1
            elif down & high:
                score -= 1
                if score < best:
                    best = score
            up = up << 1 & full
            down = down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
        return best


class Searcher:
    """All items of one block."""

    def __init__(self, items: tuple[str, ...], per_error: int):
        import ahocorasick

        self.patterns = [Pattern(t, per_error) for t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, p in enumerate(self.patterns):
            for offset, piece in p.pieces():
                places[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(item number, distance) of every item that is in ``text`` within its budget."""
        if not self.patterns or not text:
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                starts[k].append(end + 1 - size - offset)
        out = []
        for k, at in starts.items():
            p, best = self.patterns[k], None
            at.sort()
            low = 0
            for i in range(1, len(at) + 1):
                # Stretches that touch are verified as one.
                if i < len(at) and at[i] - at[i - 1] <= p.size:
                    continue
                stretch = text[max(0, at[low] - p.budget) : at[i - 1] + p.size + p.budget]
                low = i
                if p.plausible(stretch):
                    d = p.distance(stretch)
                    if d <= p.budget and (best is None or d < best):
                        best = d
            if best is not None:
                out.append((k, best))
        return sorted(out)


def searcher(items: tuple[str, ...], per_error: int) -> Searcher:
    key = (items, per_error)
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(items, per_error)
    return _SEARCHERS[key]


def blocks(benchmark: DataFrame, rules: MatchRules) -> Iterator[list[tuple[int | None, str]]]:
    """The items (id, plain text) in blocks of about ``block_chars`` characters; items without a character are left out."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / rules.block_chars))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        found = [(r.item_id, plain(r.text)) for r in part]
        yield sorted([x for x in found if x[1]], key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def matches(docs: DataFrame, benchmark: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """``doc_id, item_id, distance, budget`` for each item found in each row of ``docs``; clean documents have no row.

    Null and blank texts and items match nothing.  Repeated rows give repeated results, items with the same text are all found,
    null ids stay null, empty tables give no rows, other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("budget", pa.int64())])
    out = None
    for block in blocks(benchmark, rules):
        ids, items = [i for i, _ in block], tuple(t for _, t in block)

        def find(batch, ids=ids, items=items):
            search = searcher(items, rules.per_error)
            rows = [
                (d, ids[k], distance, search.patterns[k].budget)
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for k, distance in search.matches(plain(t or ""))
            ]
            if rows:
                yield record(schema, *zip(*rows))

        part = map_batches(texts(docs), find, "doc_id long, item_id long, distance long, budget long")
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    for block in blocks(benchmark, rules):
        items = tuple(t for _, t in block)

        def keep(batches, items=items):
            for batch in slices(batches):
                search = searcher(items, rules.per_error)
                clean = [not search.matches(plain(t or "")) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
