"""The alert state machines, each written once as a transition over small integers.

Batch replays and streaming handlers both use these functions, which is what makes their results
equal.  States are tuples held in a list; their position is the integer the machine works on.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from tracewell.config import EscalationRules, GeofenceRules, GroupRules, PdrRules
from tracewell.functions.automaton import Machine


def _machine(states: list, symbols: int, move: Callable, label: Callable) -> Machine:
    index = {s: i for i, s in enumerate(states)}
    return Machine(
        states=tuple(label(s) for s in states),
        symbols=symbols,
        step=lambda s, x: index[move(states[s], x)],
    )


# --- dead-reckoning displacement tier -------------------------------------------------------

PDR_TIERS = ("INDOOR_PACING", "ZONE_TRANSITION", "UNTRACKED_DISPLACEMENT")


def pdr_symbol(displacement: float, rules: PdrRules = PdrRules()) -> int:
    """How many of the four ascending thresholds the displacement has passed."""
    return (
        (displacement >= rules.down_to_indoor_m)
        + (displacement > rules.up_to_transition_m)
        + (displacement >= rules.down_to_transition_m)
        + (displacement > rules.up_to_untracked_m)
    )


def pdr_machine() -> Machine:
    def move(tier: str, passed: int) -> str:
        if tier == PDR_TIERS[0]:
            return PDR_TIERS[1] if passed >= 2 else tier
        if tier == PDR_TIERS[1]:
            return PDR_TIERS[{0: 0, 4: 2}.get(passed, 1)]
        return PDR_TIERS[1] if passed <= 2 else tier

    return _machine(list(PDR_TIERS), 5, move, str)


# --- geofence boundary ----------------------------------------------------------------------

INSIDE, PAST_BUFFER, ANY_INSIDE, HOLD = 1, 2, 4, 8
OPEN_BREACH = ("BREACHED", "REENTRY_PENDING")


def geofence_machine(rules: GeofenceRules = GeofenceRules()) -> Machine:
    out_n, in_n = rules.exit_readings, rules.reentry_readings
    states = [("NEW", 0), ("INSIDE", 0), ("OUTSIDE", 0), ("BREACHED", 0)]
    states += [("EXIT_PENDING", c) for c in range(1, max(out_n, 1) + 1)]
    states += [("REENTRY_PENDING", c) for c in range(1, max(in_n, 2))]

    def inside(name: str, count: int):
        if name not in OPEN_BREACH:
            return ("INSIDE", 0)
        seen = count + 1 if name == "REENTRY_PENDING" else 1
        return ("INSIDE", 0) if seen >= in_n else ("REENTRY_PENDING", seen)

    def outside(name: str, count: int, past: bool):
        if name == "NEW":
            return ("OUTSIDE", 0)
        if name == "INSIDE":
            return ("BREACHED", 0) if out_n <= 1 and past else ("EXIT_PENDING", 1)
        if name == "EXIT_PENDING":
            seen = min(count + 1, out_n)
            return ("BREACHED", 0) if seen >= out_n and past else (name, max(seen, 1))
        return ("BREACHED", 0) if name == "REENTRY_PENDING" else (name, 0)

    def move(state, x: int):
        if x & HOLD:
            return state
        new = inside(*state) if x & INSIDE else outside(*state, bool(x & PAST_BUFFER))
        # Arrival in any other zone ends a breach of this one.
        return ("OUTSIDE", 0) if new[0] == "BREACHED" and x & ANY_INSIDE else new

    return _machine(states, 16, move, lambda s: s[0])


def fence_report(was: str, now: str, poor: bool) -> tuple[str, str]:
    """Alert action and evaluation status of one step between two named boundary states."""
    if poor:
        return "NONE", "INSUFFICIENT_GPS"
    status = "BREACH_ACTIVE" if now == "BREACHED" else "NORMAL"
    if (now in OPEN_BREACH) != (was in OPEN_BREACH):
        return ("ALERT_TRIGGERED" if now in OPEN_BREACH else "ALERT_RESOLVED"), status
    return ("ALERT_UPDATED" if now == "BREACHED" else "NONE"), status


# --- loop alerts ----------------------------------------------------------------------------

LOOPING, CORROBORATED, RELEASE, CLOSED = 1, 2, 4, 8


def loop_machine(quiet_readings: int = 2) -> Machine:
    """States are NONE or (tier, quiet streak, closed by someone)."""
    states: list = [None]
    states += list(product((2, 3), range(quiet_readings), (False, True)))

    def move(state, x: int):
        tier = 3 if x & CORROBORATED else 2
        if state is None:
            return (tier, 0, False) if x & LOOPING else None
        held, streak, closed = state
        closed = closed or bool(x & CLOSED)
        if x & LOOPING:
            return (tier if closed else max(held, tier), 0, False)
        if x & RELEASE or streak + 1 >= quiet_readings:
            return None
        return (held, streak + 1, closed)

    def label(s):
        return "NONE" if s is None else f"OPEN_T{s[0]}_Q{s[1]}" + ("_CLOSED" if s[2] else "")

    return _machine(states, 16, move, label)


def loop_action(was: str, now: str, looping: bool, closed: bool) -> str:
    """Alert action of one step between two labels of the loop machine."""
    shut = closed or was.endswith("_CLOSED")
    if looping:
        return "ALERT_TRIGGERED" if was == "NONE" or shut else "ALERT_UPDATED"
    return "ALERT_RESOLVED" if was != "NONE" and now == "NONE" and not shut else "NONE"


def loop_tier(label: str) -> int | None:
    return None if label == "NONE" else int(label.removeprefix("OPEN_T")[0])


# --- group separation -----------------------------------------------------------------------

# CLOSED (8) keeps its meaning here, so held readings use their own bit.
APART, AROUSED, GROUP_HOLD = 1, 2, 4


def group_machine(rules: GroupRules = GroupRules()) -> Machine:
    """States are (status, streak, alert) with alert none, tier 2, tier 3 or closed."""
    n_sep, n_uni = rules.separated_readings, rules.united_readings
    status = [("NEW", 0), ("WITH_COMPANION", 0), ("SEPARATED", 0)]
    status += [("SEPARATION_PENDING", c) for c in range(1, max(n_sep, 2))]
    status += [("REUNITE_PENDING", c) for c in range(1, max(n_uni, 2))]
    states = [(*s, a) for s, a in product(status, ("none", "t2", "t3", "closed"))]

    def move(state, x: int):
        name, streak, alert = state
        if x & CLOSED and alert in ("t2", "t3"):
            alert = "closed"
        if x & GROUP_HOLD:
            return (name, streak, alert)
        if x & APART:
            seen = streak + 1 if name == "SEPARATION_PENDING" else 1
            if name == "SEPARATED" or seen >= n_sep:
                tier = "t3" if x & AROUSED else "t2"
                return ("SEPARATED", 0, max(alert, tier) if alert in ("t2", "t3") else tier)
            return ("SEPARATION_PENDING", seen, alert)
        if name in ("SEPARATED", "REUNITE_PENDING"):
            seen = streak + 1 if name == "REUNITE_PENDING" else 1
            if seen < n_uni:
                return ("REUNITE_PENDING", seen, alert)
        return ("WITH_COMPANION", 0, "none")

    return _machine(states, 16, move, lambda s: f"{s[0]}|{s[2]}")


def group_action(was: str, now: str, closed: bool) -> str:
    """Alert action of one step, which was not held, between two labels of the group machine."""
    live = was.split("|")[1] in ("t2", "t3") and not closed
    name = now.split("|")[0]
    if name == "SEPARATED":
        return "ALERT_UPDATED" if live else "ALERT_TRIGGERED"
    return "ALERT_RESOLVED" if name == "WITH_COMPANION" and live else "NONE"


# --- behavior escalation --------------------------------------------------------------------

DEGRADED, GAP, EXPIRED, SAME_WINDOW = 1, 2, 4, 8
QUIET, ERROR, SAFE, ANOMALY, ANOMALY_HEART, ORDINARY = range(6)
ESCALATION_SYMBOLS = 96


def escalation_symbol(kind: int, degraded=False, gap=False, expired=False, same=False) -> int:
    return kind * 16 + degraded * DEGRADED + gap * GAP + expired * EXPIRED + same * SAME_WINDOW


def escalation_machine(rules: EscalationRules = EscalationRules()) -> Machine:
    """States are (anomalous windows, level, errors, a window id is remembered)."""
    levels = ("NONE", "S_PATTERN", "S_HEART", "C_HEART")
    states = list(product(range(rules.windows + 1), levels, range(rules.max_errors), (False, True)))
    clear = (0, "NONE", 0, False)

    def move(state, x: int):
        kind = x // 16
        if x & DEGRADED:
            return clear
        if x & GAP:
            state = clear
        count, level, errors, known = state
        if level != "NONE" and x & EXPIRED:
            return clear
        if kind == ERROR:
            if level == "NONE":
                return state
            return clear if errors + 1 >= rules.max_errors else (count, level, errors + 1, known)
        state = (count, level, 0, known)
        if kind == SAFE:
            return clear
        if kind == QUIET or (x & SAME_WINDOW and known):
            return state
        if kind == ORDINARY:
            return clear
        count = min(count + 1, rules.windows)
        sustained = count >= rules.windows
        if kind == ANOMALY_HEART:
            return (count, "C_HEART" if sustained else "S_HEART", 0, True)
        return (count, "S_PATTERN" if sustained else "NONE", 0, True)

    return _machine(
        states, ESCALATION_SYMBOLS, move, lambda s: f"{s[1]}|{s[0]}|{s[2]}|{int(s[3])}"
    )


def held_score_floor(displacement: float) -> float:
    """Least score while the signal is degraded, by displacement: 40 beyond 25 m, 75 beyond 50 m."""
    return 75.0 if displacement > 50 else 40.0 if displacement > 25 else 0.0
