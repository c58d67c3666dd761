"""The weighted ensemble, as Column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.config import SETTINGS

#: A score of exactly 0 of this detector means that it has not warmed up.
SILENT_AT_ZERO = "lstm_ae"


def ensemble_score(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted mean of the detectors' scores; equal weights by default, 0 if no weight is left.

    Detectors without a weight, and weights without a detector, don't count.
    """
    weights = weights or dict.fromkeys(scores, 1.0 / max(1, len(scores)))
    total, weight = [], []
    for name, score in scores.items():
        if name not in weights:
            continue
        w = F.lit(float(weights[name]))
        if name == SILENT_AT_ZERO:
            w = F.when(score == 0, F.lit(0.0)).otherwise(w)
        total.append(w * score)
        weight.append(w)
    if not total:
        return F.lit(0.0)
    plus = lambda a, b: a + b
    return F.when(reduce(plus, weight) == 0, F.lit(0.0)).otherwise(reduce(plus, total) / reduce(plus, weight))


def is_anomaly(score: Column, threshold: float = SETTINGS.threshold) -> Column:
    return score < threshold


def agreement(scores: Column, vote: float = -0.3) -> Column:
    """The share of detectors in a name-to-score map that vote for an anomaly."""
    return F.size(F.filter(F.map_values(scores), lambda s: s < vote)) / F.size(scores)
