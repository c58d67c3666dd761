"""Patterns as data.

A pattern is a set of states with edges on events.  State 0 is the start.  Besides plain edges a state may
have an absence (an event that stays away for so many windows moves on) and a repeat (an event that must
come at least so often before plain edges count).
"""

from __future__ import annotations

from dataclasses import dataclass, field

UP, DOWN, SURGE, DROP, SPIKE = "price_jump_up", "price_jump_down", "volume_surge", "sentiment_drop", "sentiment_spike"
PREFIX = "PATTERN:"


@dataclass(frozen=True)
class Guard:
    """A test of one feature of the window; a missing feature is 0."""

    feature: str
    test: str  # gt, lt, gte or abs_gt
    threshold: float

    def __call__(self, row: dict) -> bool:
        x = float(row.get(self.feature) or 0.0)
        if self.test == "abs_gt":
            return abs(x) > self.threshold
        return {"gt": x > self.threshold, "lt": x < self.threshold, "gte": x >= self.threshold}[self.test]


@dataclass(frozen=True)
class Edge:
    source: int
    event: str
    target: int
    gap: int | None = field(default=None, compare=False)
    guard: Guard | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Absence:
    source: int
    event: str
    target: int
    timeout: int


@dataclass(frozen=True)
class Repeat:
    state: int
    event: str
    least: int
    most: int | None = None


@dataclass(frozen=True)
class Pattern:
    name: str
    edges: tuple[Edge, ...]
    accept: int
    severity: float = 0.8
    gap: int = 3
    limit: int = 8
    absences: tuple[Absence, ...] = ()
    repeats: tuple[Repeat, ...] = ()


def default_patterns(gap: int = 3) -> tuple[list[Pattern], list[Pattern]]:
    """Base patterns, and meta patterns over the base patterns' PATTERN: events.  Fixed values throughout."""
    either = (Edge(1, UP, 2), Edge(1, DOWN, 2))
    base = [
        Pattern("volume_led_breakout", (Edge(0, SURGE, 1), *either), 2, 0.85, 2),
        Pattern("news_driven_selloff", (Edge(0, DROP, 1), Edge(1, DOWN, 2)), 2, 0.90, gap),
        Pattern("flash_reversal", (Edge(0, UP, 1), Edge(0, DOWN, 2), Edge(1, DOWN, 3, 1), Edge(2, UP, 3, 1)), 3, 0.80, 2),
        Pattern("panic_compound", (Edge(0, SURGE, 1), Edge(1, DROP, 2, gap + 1), Edge(2, DOWN, 3, 2)), 3, 1.0, gap),
        Pattern("failed_breakout", (Edge(0, SURGE, 1),), 2, 0.50, gap, absences=(Absence(1, UP, 2, 2),)),
        Pattern("sustained_selloff", (Edge(0, DOWN, 1, guard=Guard("price_change_rate", "abs_gt", 0.03)),), 2, 0.50, gap, absences=(Absence(1, UP, 2, 2),)),
        Pattern("sustained_accumulation", (Edge(0, SURGE, 1), *either), 2, 0.90, 2, repeats=(Repeat(1, SURGE, 3),)),
    ]
    meta = [
        Pattern("reversal_confirmed", (Edge(0, PREFIX + "flash_reversal", 1), Edge(1, SURGE, 2)), 2, 0.95, 5),
        Pattern("pump_and_dump", (Edge(0, PREFIX + "volume_led_breakout", 1), Edge(1, PREFIX + "news_driven_selloff", 2)), 2, 1.0, 10),
    ]
    return base, meta
