"""Role order of conversations as least-cost edits, by Four-Russians block tables.

The roles of a sound conversation read ``(s?(ua)+)?``; the automaton has four states: START, after s, after u, after a.  A row is one
of nine symbols: its role and whether it is truncated, or "must go" (``x``).  The cost of reaching each state is a vector; taken less
its least entry, and without entries that no cheapest path can use, only a few dozen vectors exist.  So the move of every vector over
every block of BLOCK symbols is precomputed, and a conversation is read block by block by lookup.

For the edits themselves blocks are expanded backward from the states that a cheapest path may end in.  An expansion marks every edit
on some cheapest path and keeps, for each state before the block, the least letter at each step.  A letter leads from one state to
one state only, so the first differing letter settles a tie and the least sequence is found without comparing sequences.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache
from itertools import product

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, S, U, A = range(4)
STATES = range(4)
#: Where a role leads; no entry: not allowed there.
NEXT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
#: What an inserted or renamed row must be in each state.
WANTED = {START: "u", S: "u", U: "a", A: "u"}
NAMES = {"u": "user", "a": "assistant"}
#: Edits that end a conversation in each state, and their cost.
ENDINGS = ("", "II", "I", "")
INF = 1 << 40
END = tuple(INSERT * len(e) for e in ENDINGS)
#: From any state, any other state can be imitated at this extra cost, so dearer entries are on no cheapest path.
SLACK = 10
SYMBOLS = "suaoSUAOx"
BLOCK = 3

Vector = tuple[int, int, int, int]


def symbol(role: str, truncated: bool) -> str:
    """Symbol of a row that may stay; capitals are truncated, ``o`` is a role that begins with none of s, u, a."""
    first = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return first.upper() if truncated else first


def choices(sym: str, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of the edits that use up a row, in ASCII order of the letters."""
    out = [("D", DELETE, state)]
    if sym != "x":
        late = TRUNCATED * sym.isupper()
        kept = NEXT.get(sym.lower(), {}).get(state)
        if kept is not None:
            out.append(("K", KEEP + late, kept))
        out.append(("R", REROLE + late, NEXT[WANTED[state]][state]))
    return out


def normal(costs) -> tuple[int, Vector]:
    """Least entry, and the vector less it without entries that no cheapest path uses."""
    least = min(costs)
    return least, tuple(c - least if c - least <= SLACK else INF for c in costs)


def inserted(costs) -> list[int]:
    """Costs after any rows were inserted."""
    c = list(costs)
    c[U] = min(c[U], min(c[START], c[S], c[A]) + INSERT)
    c[A] = min(c[A], c[U] + INSERT)
    return c


def moved(costs, sym: str) -> list[int]:
    out = [INF] * 4
    for state, c in enumerate(inserted(costs)):
        if c < INF:
            for _, cost, to in choices(sym, state):
                out[to] = min(out[to], c + cost)
    return out


def unit(state: int) -> Vector:
    return tuple(0 if s == state else INF for s in STATES)


@lru_cache(maxsize=1)
def tables() -> tuple[dict, dict]:
    """Moves of every vector over every symbol, and over every block of BLOCK symbols: ``(block, vector) -> (added cost, vector)``."""
    one: dict = {}
    waiting, seen = deque(unit(s) for s in STATES), {unit(s) for s in STATES}
    while waiting:
        v = waiting.popleft()
        for sym in SYMBOLS:
            one[sym, v] = normal(moved(v, sym))
            if (w := one[sym, v][1]) not in seen:
                seen.add(w)
                waiting.append(w)
    many = {}
    for symbols in product(SYMBOLS, repeat=BLOCK):
        block = "".join(symbols)
        for v in seen:
            cost, w = 0, v
            for sym in block:
                more, w = one[sym, w]
                cost += more
            many[block, v] = cost, w
    return one, many


def blocks(symbols: str) -> list[str]:
    return [symbols[i : i + BLOCK] for i in range(0, len(symbols), BLOCK)]


def read(symbols: str, vector: Vector) -> tuple[int, list[Vector]]:
    """Added cost, and the vectors before every block and at the end."""
    one, many = tables()
    total, out = 0, [vector]
    for block in blocks(symbols):
        if len(block) == BLOCK:
            cost, vector = many[block, vector]
        else:
            cost = 0
            for sym in block:
                more, vector = one[sym, vector]
                cost += more
        total += cost
        out.append(vector)
    return total, out


@lru_cache(maxsize=200_000)
def expand(block: str, vector: Vector, ends: frozenset[int]) -> dict[int, tuple[str, int]]:
    """For each state before the block on a cheapest path to ``ends``: the least letters over the block, and the state they end in."""
    before = [vector]
    for sym in block:
        before.append(tuple(moved(before[-1], sym)))
    nodes = [inserted(v) for v in before[:-1]]
    known: dict[tuple[int, int], tuple[str, int] | None] = {}

    def least(j: int, state: int) -> tuple[str, int] | None:
        if (j, state) not in known:
            known[j, state] = None
            here = nodes[j][state]
            (d, *rest) = choices(block[j], state)
            to = NEXT[WANTED[state]][state]
            found = onward(j, here, d)
            if found is None and here + INSERT == nodes[j][to] and (tail := least(j, to)):
                found = "I" + tail[0], tail[1]
            for choice in rest:
                found = found or onward(j, here, choice)
            known[j, state] = found
        return known[j, state]

    def onward(j: int, here: int, choice: tuple[str, int, int]) -> tuple[str, int] | None:
        letter, cost, to = choice
        if here >= INF or here + cost != before[j + 1][to]:
            return None
        if j + 1 == len(block):
            return (letter, to) if to in ends else None
        tail = least(j + 1, to) if nodes[j + 1][to] == before[j + 1][to] else None
        return (letter + tail[0], tail[1]) if tail else None

    first = {s: least(0, s) for s in STATES if vector[s] < INF and nodes[0][s] == vector[s]}
    return {s: f for s, f in first.items() if f}


def trace(symbols: str, vectors: list[Vector], ends: frozenset[int]) -> dict[int, tuple[list[str], int]]:
    """Letters over each block and the last state, by first state; blocks are expanded from the last to the first."""
    parts, expanded = blocks(symbols), []
    for block, vector in zip(reversed(parts), reversed(vectors[:-1])):
        expanded.append(expand(block, vector, ends))
        ends = frozenset(expanded[-1])
    out = {}
    for first in ends:
        letters, state = [], first
        for block in reversed(expanded):
            piece, state = block[state]
            letters.append(piece)
        out[first] = letters, state
    return out


def cheapest(symbols: str) -> tuple[int, str]:
    """Cost and least letters of the cheapest edits of a whole conversation."""
    cost, vectors = read(symbols, unit(START))
    last = [c + e for c, e in zip(vectors[-1], END)]
    letters, state = trace(symbols, vectors, frozenset(s for s in STATES if last[s] == min(last)))[START]
    return cost + min(last), "".join(letters) + ENDINGS[state]


def matrix(symbols: str) -> list[list[int]]:
    """Cost from each state before the symbols to each state after them."""
    out = []
    for s in STATES:
        cost, vectors = read(symbols, unit(s))
        out.append([cost + c if c < INF else INF for c in vectors[-1]])
    return out


def joined(matrices: list[list[list[int]]]) -> tuple[list[Vector], list[frozenset[int]], int]:
    """For consecutive stretches: the vector before each, the states after it that a cheapest path may have, and the least cost."""
    forward = [list(unit(START))]
    for m in matrices:
        forward.append([min(min(forward[-1][i] + m[i][j] for i in STATES), INF) for j in STATES])
    backward = [list(END)]
    for m in reversed(matrices):
        backward.append([min(min(m[i][j] + backward[-1][j] for j in STATES), INF) for i in STATES])
    total = min(a + b for a, b in zip(forward[-1], END))
    after = [frozenset(s for s in STATES if f[s] + b[s] == total) for f, b in zip(forward[1:], reversed(backward[:-1]))]
    return [normal(f)[1] for f in forward[:-1]], after, total


def apply_edits(letters: str, rows: list[tuple[str, str]], state: int) -> tuple[list[str], int]:
    """Lines ``role:text`` after the edits, which use up ``rows`` from ``state`` on, and the state reached."""
    lines, at = [], 0
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        first = WANTED[state] if letter in "IR" else role[0]
        lines.append(f"{role if letter == 'K' else NAMES[first]}:{text}")
        state = NEXT[first][state]
    return lines, state
