"""Settings of the engine; every operator takes the values as arguments, these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Sources and windows.
    tickers: tuple[str, ...] = ("T0", "T1", "T2", "T3", "T4")
    price_poll_seconds: int = 60
    news_poll_seconds: int = 120
    window_minutes: int = 5
    grace_seconds: int = 30
    sentiment_rows: int = 20
    sentiment_recent: int = 10
    seen_titles: int = 1000
    # Reasons and severity.
    reason_price_change: float = 0.02
    reason_volume: int = 1_000_000
    reason_sentiment_shift: float = 0.3
    severity_high: float = -0.7
    # Detectors.
    weights: dict[str, float] = field(default_factory=lambda: {"ewma": 0.40, "hst": 0.05, "isolation_forest": 0.45, "lstm_ae": 0.10})
    threshold: float = -0.28
    ewma_span: int = 20
    hst_trees: int = 25
    hst_height: int = 6
    hst_window: int = 50
    sequence_length: int = 12
    hidden: int = 32
    drift_enabled: bool = True
    drift_delta: float = 0.002
    # Complex events.
    price_jump: float = 0.02
    volume_surge_ratio: float = 3.0
    sentiment_drop: float = -0.3
    sentiment_floor: float = -0.5
    sentiment_spike: float = 0.3
    baseline_span: int = 20
    baseline_min_windows: int = 3
    pattern_gap: int = 3
    point_severity: float = 0.55
    cep_threshold: float = -0.5
    # Evaluation.
    train_ratio: float = 0.7
    injection_rate: float = 0.05
    seed: int = 42
    warmup_rows: int = 50
    tolerance: int = 2


SETTINGS = Settings()

#: The features that the detectors read, in order.
FEATURES = ("price_change_rate", "total_volume", "avg_sentiment", "sentiment_shift")
