"""ADWIN (Bifet, Gavalda 2007): a window that shrinks where its two parts' means differ too much to be chance."""

from __future__ import annotations

from math import log, sqrt

from tidewater.config import FEATURES, SETTINGS

from .base import values

#: Buckets of one size at most, rows between checks, and rows of a part and of a window at least.
BUCKETS, CLOCK, LEAST_PART, GRACE = 5, 32, 5, 10


class Adwin:
    """Buckets of 2**i rows hold (sum, sum of squared deviations); memory grows with the logarithm of the window."""

    def __init__(self, delta: float = SETTINGS.drift_delta) -> None:
        self.delta = delta
        self.rows: list[list[tuple[float, float]]] = [[]]
        self.width, self.total, self.spread, self.ticks = 0, 0.0, 0.0, 0

    def update(self, x: float) -> bool:
        """Whether the window had to shrink."""
        self.ticks += 1
        if self.width:
            mean = self.total / self.width
            self.spread += self.width * (x - mean) * (x - mean) / (self.width + 1)
        self.width += 1
        self.total += x
        self.rows[0].append((x, 0.0))
        i = 0
        while len(self.rows[i]) > BUCKETS:
            if i + 1 == len(self.rows):
                self.rows.append([])
            (s1, v1), (s2, v2) = self.rows[i][:2]
            del self.rows[i][:2]
            n = 1 << i
            self.rows[i + 1].append((s1 + s2, v1 + v2 + (s1 - s2) * (s1 - s2) / (2 * n)))
            i += 1
        shrunk = False
        if self.ticks % CLOCK == 0 and self.width > GRACE:
            while self._drop_if_changed():
                shrunk = True
        return shrunk

    def _drop_if_changed(self) -> bool:
        n0, s0 = 0, 0.0
        for i in reversed(range(len(self.rows))):
            for s, _ in self.rows[i]:
                n0, s0 = n0 + (1 << i), s0 + s
                n1 = self.width - n0
                if n1 < LEAST_PART:
                    return False
                if n0 >= LEAST_PART and self._differ(n0, s0 / n0, n1, (self.total - s0) / n1):
                    self._drop_oldest()
                    return True
        return False

    def _differ(self, n0: int, m0: float, n1: int, m1: float) -> bool:
        d = log(2 * log(self.width) / self.delta)
        variance = self.spread / self.width
        m = 1 / (n0 - LEAST_PART + 1) + 1 / (n1 - LEAST_PART + 1)
        return abs(m0 - m1) > sqrt(2 * m * variance * d) + 2 / 3 * d * m

    def _drop_oldest(self) -> None:
        i = max(k for k, r in enumerate(self.rows) if r)
        s, v = self.rows[i].pop(0)
        n = 1 << i
        self.width -= n
        self.total -= s
        mean = self.total / self.width if self.width else 0.0
        self.spread = max(0.0, self.spread - v - n * self.width * (s / n - mean) ** 2 / (n + self.width))


class DriftMonitor:
    """One ADWIN per feature of a key."""

    def __init__(self, delta: float = SETTINGS.drift_delta) -> None:
        self.windows = {f: Adwin(delta) for f in FEATURES}

    def update(self, row: dict) -> list[str]:
        """The features that drifted."""
        return [f for f, x in zip(FEATURES, values(row), strict=True) if self.windows[f].update(x)]
