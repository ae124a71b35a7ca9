import hashlib
import random
import re
import zlib

from tracewell.llm import conversations as C
from tracewell.llm import turns as T


def brute_edits(symbols):
    """Least (cost, letters) by dynamic programming over whole strings, from the end."""
    best = {}
    for i in range(len(symbols), -1, -1):
        here = {}
        for s in T.STATES:
            ways = [(0, "")] if i == len(symbols) and s in (T.START, T.A) else []
            for letter, cost, to in T.choices(symbols[i], s) if i < len(symbols) else []:
                if to in best:
                    ways.append((best[to][0] + cost, letter + best[to][1]))
            if ways:
                here[s] = min(ways)
        for _ in range(3):
            for s in T.STATES:
                tail = here.get(T.NEXT[T.WANTED[s]][s])
                if tail:
                    here[s] = min(here.get(s, (T.INF, "")), (tail[0] + T.INSERT, "I" + tail[1]))
        best = here
    return best[T.START]


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        for _ in range({0: 0, 3: 2}.get(d, 1)):
            yield conv, turn, "user" if d == 4 else role, text


def brute(rows, damage=True):
    left = list(damaged(rows) if damage else rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, symbols, n = set(), "", {"b": 0, "d": 0, "t": 0, "-": 0}
        for _, _, role, text in mine:
            end = text.rstrip(" \t\n\v\f\r")
            fault = "b" if not end else "d" if (role, text) in seen else "-" if end[-1] in ".!?" else "t"
            seen.add((role, text))
            n[fault] += 1
            first = role[:1] if role[:1] in tuple("sua") else "o"
            symbols += "x" if fault in "bd" else first.upper() if fault == "t" else first
        cost, audit = brute_edits(symbols)
        lines, at, state = [], 0, T.START
        for letter in audit:
            role, text = ("", "") if letter == "I" else mine[at][2:]
            at += letter != "I"
            if letter != "D":
                role = role if letter == "K" else "assistant" if state == T.U else "user"
                lines.append(f"{role}:{text}")
                state = T.NEXT[role[0]][state]
        known = [r[1] for r in mine if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(frame):
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def test_block_tables():
    rnd = random.Random(1)
    for k in range(3000):
        symbols = "".join(rnd.choice(T.SYMBOLS if k % 2 else "suaUAx") for _ in range(rnd.randint(0, 14)))
        assert T.cheapest(symbols) == brute_edits(symbols)
        cuts = sorted(rnd.choices(range(len(symbols) + 1), k=3))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
        vectors, ends, total = T.joined([T.matrix(p) for p in parts])
        state, letters = T.START, ""
        for p, v, e in zip(parts, vectors, ends):
            piece, state = T.trace(p, T.read(p, v)[1], e)[state]
            letters += "".join(piece)
        assert (total, letters + T.ENDINGS[state]) == T.cheapest(symbols)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    out = C.repair_conversations(df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert run(out) == brute(rows)


def test_long_conversations_in_chunks(spark):
    rnd = random.Random(7)
    texts = ["Yes.", "no", " ", "", "Well!", "a longer one\n", "Long " * 3000 + "."] + [f"t{i}." for i in range(300)]
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "assistant", "tool"]), rnd.choice(texts)) for c, n in ((1, 400), (2, 150), (3, 3), (4, 90), (None, 60)) for t in range(n)]
    df = spark.createDataFrame([(*r, True, 1) for r in rows], "conv_id long, turn long, role string, text string, alive boolean, h int")
    assert run(C.repair(df.repartition(3), 7, 500)) == brute(rows, damage=False)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "Hi."), (1, 5, "assistant", "Yes" + "." * 100_000), (2, 1, "user", "same."), (2, 2, "user", "same."), (None, 3, "system", "s."), (9, 0, "", "x.")]
    rows += [(k, t, "user", "word?") for k in range(20, 60) for t in range(2)]
    df = spark.createDataFrame([(*r, True, "k") for r in rows], "conv_id long, turn long, role string, text string, alive boolean, fault string")
    assert run(C.repair_conversations(df)) == brute(rows)
    assert run(C.repair_conversations(df.limit(0))) == {}
