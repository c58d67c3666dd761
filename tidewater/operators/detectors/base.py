"""The contract of a detector."""

from __future__ import annotations

from abc import ABC, abstractmethod

from tidewater.config import FEATURES


class Detector(ABC):
    """Scores a row with what it has learned so far; learns the row afterwards."""

    name = ""

    @abstractmethod
    def score(self, row: dict) -> float: ...

    def update(self, row: dict) -> None:
        """Stateless detectors learn nothing."""


def values(row: dict) -> list[float]:
    """The row's features in order, 0 for what is missing."""
    return [float(row.get(f) or 0.0) for f in FEATURES]
