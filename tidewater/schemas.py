"""Schemas of topics and tables."""

from __future__ import annotations

# Topics.
RAW_PRICES = "ticker string, timestamp string, open double, high double, low double, close double, volume long"
RAW_NEWS = "ticker string, timestamp string, headline string, source string, sentiment_score double, sentiment_label string"
STREAM_FEATURES = "ticker string, window_start long, window_end long, avg_close double, first_close double, last_close double, price_change_rate double, total_volume long, tick_count long"
STREAM_ANOMALIES = "ticker string, anomaly_score double, is_anomaly boolean, features struct<price_change_rate:double,total_volume:double,avg_sentiment:double,sentiment_shift:double>, reason string, detector_scores map<string,double>"

# Tables; each is partitioned by the day of its time column.
TABLES = {
    "price_ticks": ("time timestamp, ticker string, open double, high double, low double, close double, volume long", "time"),
    "sentiment_scores": ("id long, time timestamp, ticker string, headline string, source string, sentiment_score double, sentiment_label string", "time"),
    "feature_vectors": ("window_start timestamp, window_end timestamp, ticker string, avg_close double, price_change_rate double, total_volume long, avg_sentiment double, sentiment_shift double, headline_count long, anomaly_score double, is_anomaly boolean, detector_scores map<string,double>", "window_end"),
    "anomaly_alerts": ("id long, detected_at timestamp, ticker string, anomaly_score double, features string, reason string, detector_scores map<string,double>", "detected_at"),
    "model_versions": ("id long, model_name string, version int, trained_at timestamp, training_data_start timestamp, training_data_end timestamp, sample_count long, anomaly_rate double, score_mean double, score_std double, model_path string, is_active boolean, metadata string", None),
    "drift_events": ("id long, detected_at timestamp, ticker string, feature_name string, drift_type string, details map<string,double>", "detected_at"),
}

#: What tells the rows of each table apart.
KEYS = {
    "price_ticks": ["time", "ticker"],
    "sentiment_scores": ["time", "ticker", "headline"],
    "feature_vectors": ["window_end", "ticker"],
    "anomaly_alerts": ["detected_at", "ticker"],
    "model_versions": ["model_name", "version"],
    "drift_events": ["detected_at", "ticker", "feature_name"],
}
