"""Conversation structure repair in Spark: faults, cheapest edits (``turns``) and the repaired text of every conversation.

Rows are put in order by one range shuffle, which cuts a conversation of any length into stretches of neighbouring tasks.  A task
streams its rows; a conversation that lies whole inside a task and is short is finished there.  All others leave chunks of bounded
size; their repeated rows, costs and edits are settled on narrow columns (digests, symbols, four-by-four cost matrices, state maps),
and only then the edits are applied to the chunks.  The hash of a long repaired conversation is a running one over its chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewell.llm import turns as T
from tracewell.session import store

#: Most rows and code points of a chunk (one row at least).
CHUNK_ROWS, CHUNK_CHARS = 256, 65_536
BLANKS = " \t\n\x0b\x0c\r"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SOUND = ("su", "ua", "au")


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``: a row is dropped, emptied, stripped of ``[.!?]``, repeated or renamed.

    A dropped row stays as a mark without turn, role and text (``alive`` false), so its conversation is not lost.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    base = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("d"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("d") != 0))).alias("alive")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = base.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies)
    return out.select("conv_id", "alive", *[F.when(F.col("alive"), F.col(c)).alias(c) for c in ("turn", "role", "text")])


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of ``conv_id, alive, turn, role, text`` by conversation and turn (nulls first), then role and a hash of the text.

    Equal rows may fall on both sides of a cut; it does not matter which copy is where.
    """
    end = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(end == "", "b").when(F.substring(end, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    marked = rows.select("conv_id", "alive", "turn", "role", "text", fault.alias("fault"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("copy"))
    order = ["conv_id", "turn", "role", "h", "copy"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("h", "copy")


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


class _Chunk:
    """Rows of one conversation in order, up to the bound."""

    def __init__(self, conv_id, seq: int):
        self.conv_id, self.seq, self.chars = conv_id, seq, 0
        self.turns: list = []
        self.rows: list[tuple[str, str]] = []
        self.faults: list[str] = []

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.turns.append(turn)
        self.rows.append((role, text))
        self.faults.append(fault)
        self.chars += len(text)

    def summary(self) -> dict:
        """Symbols with the repeats inside the chunk marked, digests of all other rows with text, and what gaps and roles need."""
        seen, symbols, digests = set(), [], []
        counts = {"b": 0, "d": 0, "t": 0}
        for (role, text), fault in zip(self.rows, self.faults):
            if fault != "b" and (role, text) in seen:
                fault = "d"
            seen.add((role, text))
            symbols.append("x" if fault in "bd" else T.symbol(role, fault == "t"))
            digests.append(None if fault in "bd" else (role, text))
            if fault in counts:
                counts[fault] += 1
        known = [t for t in self.turns if t is not None]
        initials = [role[:1] for role, _ in self.rows]
        return {
            "symbols": "".join(symbols), "digests": digests, "blank": counts["b"], "duplicate": counts["d"], "truncated": counts["t"],
            "illegal": sum(a + b not in SOUND for a, b in zip(initials, initials[1:])), "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
            "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)), "n": len(self.rows),
        }

    def finished(self) -> dict:
        x = self.summary()
        cost, audit = T.cheapest(x["symbols"])
        lines, _ = T.apply_edits(audit, self.rows, T.START)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = x["high"] - x["low"] + 1 - x["turns"] if x["turns"] else 0
        return {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": sha} | {k: x[k] for k in ("blank", "duplicate", "truncated", "illegal")}


def chunks(ordered: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per finished conversation (``whole``) or chunk of an open one, numbered by task (``part``) and ``seq``.

    The first and the last conversation of a task may go on next door, so they stay open.
    """
    key = next(f for f in ordered.schema.fields if f.name == "conv_id").dataType.simpleString()
    extra = "symbols string, digests array<binary>, first string, last string, low long, high long, turns long, n long, roles array<string>, texts array<string>"
    schema = f"conv_id {key}, part int, seq int, whole boolean, {RESULT}, {extra}"
    arrow = _arrow(schema)
    def entry(chunk: _Chunk, whole: bool, part: int) -> dict:
        base = {"conv_id": chunk.conv_id, "part": part, "seq": chunk.seq, "whole": whole}
        if whole:
            return base | chunk.finished()
        x = chunk.summary()
        x["digests"] = [d and digest(*d) for d in x["digests"]]
        return base | x | {"roles": [r for r, _ in chunk.rows], "texts": [t for _, t in chunk.rows]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        chunk, inner, ready, size = None, False, [], 0
        for batch in batches:
            for conv_id, alive, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk is None:
                    chunk = _Chunk(conv_id, 0)
                elif conv_id != chunk.conv_id:
                    ready.append(entry(chunk, inner and not chunk.seq, part))
                    chunk, inner = _Chunk(conv_id, 0), True
                elif alive and (len(chunk.rows) >= chunk_rows or chunk.chars >= chunk_chars):
                    ready.append(entry(chunk, False, part))
                    chunk = _Chunk(conv_id, chunk.seq + 1)
                size += len(text or "")
                if alive:
                    chunk.add(turn, role, text, fault)
                if size > 4_000_000 and ready:
                    yield pa.RecordBatch.from_pylist(ready, arrow)
                    ready, size = [], 0
        if chunk is not None:
            ready.append(entry(chunk, False, part))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, arrow)
    return ordered.select("conv_id", "alive", "turn", "role", "text", "fault").mapInArrow(run, schema)


def _same(a: str, b: str, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def _marked(open_chunks: DataFrame) -> DataFrame:
    """Open chunks without texts; rows that an earlier chunk of the conversation holds become symbol ``x`` and are counted."""
    at = F.struct("part", "seq")
    rows = open_chunks.select("conv_id", "part", "seq", F.posexplode("digests").alias("at", "digest")).where("digest is not null")
    first = rows.groupBy("conv_id", "digest").agg(F.min(at).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = rows.alias("r").join(first.alias("f"), _same("r", "f", "conv_id", "digest")).where(F.struct("r.part", "r.seq") > F.col("f.first"))
    later = later.groupBy("r.conv_id", "r.part", "r.seq").agg(F.collect_list("r.at").alias("again"))
    narrow = open_chunks.select("conv_id", "part", "seq", "symbols", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "n")
    both = narrow.alias("c").join(later.alias("l"), _same("c", "l", "conv_id", "part", "seq"), "left").select("c.*", F.coalesce("l.again", F.array().cast("array<int>")).alias("again"))
    symbols = F.expr("array_join(transform(split(symbols, ''), (s, i) -> if(array_contains(again, i), 'x', s)), '')")
    lost = F.expr("cast(size(filter(again, i -> substring(symbols, i + 1, 1) in ('S', 'U', 'A', 'O'))) as bigint)")
    changed = {"duplicate": F.col("duplicate") + F.size("again"), "truncated": F.col("truncated") - lost, "symbols": symbols}
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in narrow.columns])


def _counts(marked: DataFrame) -> DataFrame:
    """Counts of whole conversations from those of their chunks and what meets at the cuts."""
    order = Window.partitionBy("conv_id").orderBy("part", "seq")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    met = marked.select("*", F.last("last", True).over(past).alias("left"), F.last("high", True).over(past).alias("before"))
    pair = F.when(F.col("left").isNotNull() & F.col("first").isNotNull(), (~F.concat("left", "first").isin(*SOUND)).cast("long")).otherwise(0)
    shared = (F.col("low") == F.col("before")).cast("long")
    gaps = F.max("high") - F.min("low") + 1 - (F.sum("turns") - F.sum(F.coalesce(shared, F.lit(0))))
    totals = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    return met.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *totals, F.sum(F.col("illegal") + pair).alias("illegal"))


def _letters(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, cost`` of every open conversation, and ``conv_id, part, seq, state, letters`` of its chunks.

    A stretch is what one task held of a conversation; its symbols take a byte a row.  Stretches meet as cost matrices, which give the
    vector before each and the states a cheapest path may leave it in, and as maps from first to last state.
    """
    key = marked.schema["conv_id"].dataType.simpleString()
    parts = F.array_sort(F.collect_list(F.struct("seq", "symbols")))
    stretches = store(marked.groupBy("conv_id", "part").agg(parts.alias("x")).select("conv_id", "part", F.col("x.seq").alias("seqs"), F.col("x.symbols").alias("symbols")))

    def costs(pdfs):
        for pdf in pdfs:
            yield pdf[["conv_id", "part"]].assign(m=[[c for row in T.matrix("".join(s)) for c in row] for s in pdf["symbols"]])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        vectors, ends, total = T.joined([[list(map(int, m[i : i + 4])) for i in range(0, 16, 4)] for m in pdf["m"]])
        final = [False] * (len(pdf) - 1) + [True]
        return pdf[["conv_id", "part"]].assign(vector=[list(v) for v in vectors], ends=[sorted(e) for e in ends], cost=total, final=final)

    def walk(pdfs):
        for pdf in pdfs:
            ways = []
            for s, v, e, final in zip(pdf["symbols"], pdf["vector"], pdf["ends"], pdf["final"]):
                whole, vector = "".join(s), tuple(map(int, v))
                found = T.trace(whole, T.read(whole, vector)[1], frozenset(map(int, e)))
                ways.append([(first, last, _dealt("".join(letters) + T.ENDINGS[last] * final, first, list(s))) for first, (letters, last) in sorted(found.items())])
            yield pdf[["conv_id", "part", "seqs"]].assign(ways=ways)

    matrices = stretches.mapInPandas(costs, f"conv_id {key}, part int, m array<long>")
    entries = store(matrices.groupBy("conv_id").applyInPandas(meet, f"conv_id {key}, part int, vector array<long>, ends array<int>, cost long, final boolean"))
    both = stretches.alias("s").join(entries.alias("e"), _same("s", "e", "conv_id", "part")).select("s.*", "e.vector", "e.ends", "e.final")
    piece = "struct<state int, letters string>"
    ways = store(both.mapInPandas(walk, f"conv_id {key}, part int, seqs array<int>, ways array<struct<first int, last int, pieces array<{piece}>>>"))
    maps = F.array_sort(F.collect_list(F.struct("part", F.transform("ways", lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"))).alias("to"))))
    follow = """aggregate(maps, struct(0 as state, cast(array() as array<struct<part: int, state: int>>) as way),
        (a, m) -> struct(filter(m.to, x -> x.first = a.state)[0].last as state, concat(a.way, array(struct(m.part as part, a.state as state))) as way), a -> a.way)"""
    states = ways.groupBy("conv_id").agg(maps.alias("maps")).select("conv_id", F.explode(F.expr(follow)).alias("w")).select("conv_id", "w.part", "w.state")
    taken = ways.alias("w").join(states.alias("s"), _same("w", "s", "conv_id", "part")).select("w.conv_id", "w.part", "w.seqs", F.expr("filter(w.ways, x -> x.first = s.state)[0].pieces").alias("pieces"))
    dealt = taken.select("conv_id", "part", F.explode(F.arrays_zip("seqs", "pieces")).alias("x"))
    return entries.where("final").select("conv_id", "cost"), dealt.select("conv_id", "part", F.col("x.seqs").alias("seq"), "x.pieces.state", "x.pieces.letters")


def _dealt(letters: str, state: int, symbols: list[str]) -> list[tuple[int, str]]:
    """State before each chunk and its letters; an insertion goes with the row after it, the last ones with the last chunk."""
    out, at = [], 0
    for i, chunk in enumerate(symbols):
        begin, used = at, 0
        while at < len(letters) and (used < len(chunk) or i == len(symbols) - 1):
            used += letters[at] != "I"
            at += 1
        piece = letters[begin:at]
        out.append((state, piece))
        _, state = T.apply_edits(piece, [(s.lower(), "") for s in chunk], state)
    return out


def _repaired(open_chunks: DataFrame, letters: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256``: edits applied chunk by chunk, then a running hash over the chunks of a conversation."""
    key = open_chunks.schema["conv_id"].dataType.simpleString()
    both = open_chunks.select("conv_id", "part", "seq", "roles", "texts").alias("c").join(letters.alias("l"), _same("c", "l", "conv_id", "part", "seq"))

    def edit(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                lines, _ = T.apply_edits(x["letters"], list(zip(x["roles"], x["texts"])), x["state"])
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in ("conv_id", "part", "seq", "letters")} | {"lines": "\n".join(lines) if lines else None}], edited)

    def run(batches):
        now, audit, sha, begun = None, [], None, False
        for batch in batches:
            for conv_id, piece, lines in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "letters", "lines"))):
                if sha is None or conv_id != now:
                    if sha is not None:
                        yield record_of(now, audit, sha)
                    now, audit, sha, begun = conv_id, [], hashlib.sha256(), False
                audit.append(piece)
                if lines is not None:
                    sha.update(("\n" * begun + lines).encode())
                    begun = True
        if sha is not None:
            yield record_of(now, audit, sha)

    def record_of(conv_id, audit, sha):
        return pa.RecordBatch.from_pylist([{"conv_id": conv_id, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], hashed)

    edited_ddl, hashed_ddl = f"conv_id {key}, part int, seq int, letters string, lines string", f"conv_id {key}, audit string, repaired_sha256 string"
    edited, hashed = _arrow(edited_ddl), _arrow(hashed_ddl)
    pieces = both.select("c.conv_id", "c.part", "c.seq", "c.roles", "c.texts", "l.state", "l.letters").mapInArrow(edit, edited_ddl)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, hashed_ddl)


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of damaged ``rows``.

    ``rows`` has ``conv_id, alive, turn, role, text``; a row that is not ``alive`` only names its conversation.  Null conversations
    are one.  Rows of one turn go by role, then by a hash of the text.  A role that begins with none of s, u, a can not be kept.
    """
    table = store(chunks(in_order(rows), chunk_rows, chunk_chars))
    names = [c.split()[0] for c in RESULT.split(", ")]
    done = table.where("whole").select("conv_id", *names)
    open_chunks = table.where("not whole")
    marked = store(_marked(open_chunks))
    costs, letters = _letters(marked)
    rest = _counts(marked).alias("n").join(costs.alias("c"), _same("n", "c", "conv_id"))
    rest = rest.join(_repaired(open_chunks, letters).alias("r"), _same("n", "r", "conv_id"))
    return done.unionByName(rest.select("n.*", "c.cost", "r.audit", "r.repaired_sha256"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """``repair`` after the contract's ``damage``; of other columns none is read.  A table without rows gives none."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return repair(damage(conversations)).select(*names)
