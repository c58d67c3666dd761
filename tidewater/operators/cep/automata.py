"""Automata over windows of events.  Their state is plain tuples, so that a stream can keep it."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from .patterns import Edge, Pattern


class Single:
    """One state per key: a deterministic automaton."""

    def __init__(self, pattern: Pattern) -> None:
        self.pattern, self.steps = pattern, {(e.source, e.event): e.target for e in pattern.edges}
        self.at, self.idle = 0, 0

    def step(self, events: Iterable[str], row: dict | None = None) -> float:
        state = 0 if self.at and self.idle >= self.pattern.gap else self.at
        left, moved = sorted(set(events)), False
        while state != self.pattern.accept or not moved:
            event = next((e for e in left if (state, e) in self.steps), None)
            if event is None:
                break
            state, moved = self.steps[state, event], True
            left.remove(event)
        if state == self.pattern.accept:
            self.at = self.idle = 0
            return self.pattern.severity
        self.idle = 0 if moved or not state else self.idle + 1
        self.at = state
        return 0.0


class Run(NamedTuple):
    """A partial match."""

    state: int
    age: int
    born: int
    absent: int = 0
    repeats: int = 0


class Many:
    """Up to `limit` partial matches per key: a bounded non-deterministic automaton.

    Ages count windows of the key.  A match is dropped once its age reaches its state's gap: the largest
    of the gaps of the state's edges and absences.
    """

    def __init__(self, pattern: Pattern) -> None:
        self.pattern = pattern
        self.edges: dict[int, list[Edge]] = {}
        self.gaps: dict[int, int] = {}
        for e in pattern.edges:
            self.edges.setdefault(e.source, []).append(e)
            self.gaps[e.source] = max(self.gaps.get(e.source, 0), pattern.gap if e.gap is None else e.gap)
        for a in pattern.absences:
            self.gaps[a.source] = max(self.gaps.get(a.source, 0), a.timeout)
        self.absences = {a.source: a for a in pattern.absences}
        self.repeats = {r.state: r for r in pattern.repeats}
        self.starts = {e.event for e in self.edges.get(0, ())} | {r.event for r in pattern.repeats}
        self.runs: list[Run] = []
        self.clock = 0

    def hop(self, state: int, events: set[str], row: dict | None) -> tuple[int, bool]:
        """As many edges as the window's events allow, each event once, in alphabetical order."""
        left, moved = sorted(events), False
        while left:
            taken = next(((e, edge) for e in left for edge in self.edges.get(state, ()) if edge.event == e and (edge.guard is None or row is not None and edge.guard(row))), None)
            if taken is None:
                break
            left.remove(taken[0])
            state, moved = taken[1].target, True
            if state == self.pattern.accept:
                break
        return state, moved

    def carried(self, run: Run, events: set[str], row: dict | None, eaten: set[str]) -> tuple[Run | None, bool]:
        """(the match after this window or None, whether it was completed)."""
        repeat = self.repeats.get(run.state)
        if repeat and repeat.event in events:
            eaten.add(repeat.event)
            again = run._replace(age=0, repeats=run.repeats + 1)
            return (None if repeat.most is not None and again.repeats > repeat.most else again), False
        if repeat and run.repeats < repeat.least:
            return run._replace(age=run.age + 1), False
        state, moved = self.hop(run.state, events, row)
        absent = run.absent
        if state != self.pattern.accept and not moved and (absence := self.absences.get(state)):
            absent = 0 if absence.event in events else absent + 1
            if absent >= absence.timeout:
                state, moved, absent = absence.target, True, 0
        if state == self.pattern.accept:
            return None, True
        return run._replace(state=state, age=0 if moved else run.age + 1, absent=absent), False

    def step(self, events: Iterable[str], row: dict | None = None) -> float:
        """The severity if a match was completed in this window, else 0.

        A window that finds no match under way and starts none may be left out: only the order of births counts.
        """
        events, fired = set(events), False
        if not self.runs and self.starts.isdisjoint(events):  # most windows
            self.clock += 1
            return 0.0
        eaten: set[str] = set()
        runs: list[Run] = []
        for run in self.runs:
            if run.state and run.age >= self.gaps.get(run.state, self.pattern.gap):
                continue
            after, done = self.carried(run, events, row, eaten)
            fired |= done
            if after:
                runs.append(after)
        if (events & self.starts) - eaten and not any(r.state == 0 and r.age == 0 for r in runs):
            first = self.repeats.get(0)
            if first and first.event in events:
                runs.append(Run(0, 0, self.clock, repeats=1))
            else:
                state, _ = self.hop(0, events, row)
                if state == self.pattern.accept:
                    fired = True
                elif state:
                    runs.append(Run(state, 0, self.clock))
        if len(runs) > self.pattern.limit:
            runs = sorted(runs, key=lambda r: r.born)[-self.pattern.limit :]
        self.runs, self.clock = runs, self.clock + 1
        return self.pattern.severity if fired else 0.0
