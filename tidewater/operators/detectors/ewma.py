"""Exponentially weighted mean and variance per key and feature."""

from __future__ import annotations

from math import sqrt

from tidewater.config import SETTINGS

from .base import Detector, values

#: Variances up to this count as none, and deviations are cut at so many sigmas.
TINY, MOST = 1e-10, 8.0


class Ewma(Detector):
    """The largest deviation of a feature in sigmas, over 8, negated.  0 for a key that was never seen."""

    name = "ewma"

    def __init__(self, span: int = SETTINGS.ewma_span) -> None:
        self.alpha = 2.0 / (span + 1)
        self.state: list[tuple[float, float]] | None = None

    def score(self, row: dict) -> float:
        if self.state is None:
            return 0.0
        most = max(abs(x - m) / (sqrt(v) if v > TINY else TINY) for x, (m, v) in zip(values(row), self.state, strict=True))
        return 0.0 - min(most, MOST) / MOST

    def update(self, row: dict) -> None:
        x, a = values(row), self.alpha
        if self.state is None:
            self.state = [(v, 0.0) for v in x]
        else:
            self.state = [(a * v + (1 - a) * m, (1 - a) * (s + a * ((v - m) * (v - m)))) for v, (m, s) in zip(x, self.state, strict=True)]
