"""Queries of the dashboard's plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans import dashboard
from tidewater.sources import market
from tidewater.sources.market import NEWS_SQL

from .base import ASOF, FEATURES_SQL, SCORED_SQL, WEIGHTS, feats, flagged, query
from .relational import ALERTS_SQL, VERSIONS_SQL, alerts, versions

DAY = 24


@query("dsh01_price_history", f"WITH {FEATURES_SQL} SELECT window_end, avg_close, total_volume, price_change_rate FROM feats WHERE ticker = 'T2' AND window_end > {ASOF} - 168 * 3600000 ORDER BY window_end")
def _(s, d):
    return dashboard.price_history(feats(s, d), "T2", 168, ASOF)


@query("dsh02_latest_news", f"WITH {NEWS_SQL} SELECT ts, event_id, score, label FROM news WHERE ticker = 'T2' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(s, d):
    return dashboard.latest_news(market.news(s, d), "T2")


@query("dsh04_model_versions", f"WITH {VERSIONS_SQL} SELECT model_name, version, trained_at, sample_count FROM versions ORDER BY trained_at DESC, version DESC, model_name LIMIT 20")
def _(s, d):
    return dashboard.model_versions(versions(s, d)).drop("is_active")


@query("dsh05_alerts_in_lookback", f"WITH {ALERTS_SQL} SELECT * FROM alerts WHERE ts > {ASOF} - 100 * 3600000")
def _(s, d):
    return dashboard.in_lookback(alerts(s, d), "ts", 100, ASOF)


@query("dsh06_scl12_dsh16_detector_scores", f"WITH {SCORED_SQL} SELECT ticker, window_end, price, volume, lstm_ae FROM flagged WHERE ticker = 'T1' AND window_end > {ASOF} - 240 * 3600000")
def _(s, d):
    rows = flagged(s, d)
    return dashboard.expanded(dashboard.detector_scores(rows, 240, ASOF, "T1"), list(WEIGHTS))


@query("dsh08_feature_health", f"WITH {FEATURES_SQL} SELECT ticker, max(window_end) AS latest, count(*) FILTER (WHERE window_end > {ASOF} - {DAY} * 3600000) AS recent FROM feats GROUP BY 1")
def _(s, d):
    return dashboard.health(feats(s, d), "window_end", ASOF)


@query("dsh09_sentiment_health", f"WITH {NEWS_SQL} SELECT ticker, max(ts) AS latest, count(*) FILTER (WHERE ts > {ASOF} - {DAY} * 3600000) AS recent FROM news GROUP BY 1")
def _(s, d):
    return dashboard.health(market.news(s, d), "ts", ASOF)


@query("dsh10_alert_totals", f"WITH {ALERTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE ts > {ASOF} - {DAY} * 3600000) AS recent FROM alerts")
def _(s, d):
    return dashboard.alert_totals(alerts(s, d), ASOF)


@query("dsh11_compare_prices", f"WITH {FEATURES_SQL} SELECT ticker, window_end, avg_close FROM feats WHERE ticker IN ('T1', 'T3') AND window_end > {ASOF} - 100 * 3600000")
def _(s, d):
    return dashboard.compare(feats(s, d), ["T1", "T3"], "window_end", 100, ASOF, "avg_close")


@query("dsh12_compare_sentiment", f"WITH {NEWS_SQL} SELECT ticker, ts, event_id, score FROM news WHERE ticker IN ('T1', 'T3') AND ts > {ASOF} - 100 * 3600000")
def _(s, d):
    return dashboard.compare(market.news(s, d), ["T1", "T3"], "ts", 100, ASOF, "event_id", "score")


@query("dsh13_status", f"WITH {FEATURES_SQL}, l AS (SELECT ticker, max(window_end) AS latest FROM feats GROUP BY 1) SELECT ticker, coalesce(latest, -1) AS latest, ({ASOF} - latest) / 60000::DOUBLE AS age_minutes, CASE WHEN latest IS NULL THEN 'NO DATA' WHEN ({ASOF} - latest) / 60000::DOUBLE < 10 THEN 'LIVE' WHEN ({ASOF} - latest) / 60000::DOUBLE < 30 THEN 'STALE' ELSE 'DOWN' END AS status FROM (SELECT 'T' || CAST(range AS VARCHAR) AS ticker FROM range(7)) LEFT JOIN l USING (ticker)")
def _(s, d):
    tickers = s.range(7).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"))
    return dashboard.status(tickers, feats(s, d), ASOF).withColumn("latest", F.coalesce("latest", F.lit(-1)))


@query("dsh14_summary", f"WITH {SCORED_SQL} SELECT ticker, arg_max(avg_close, window_end) AS latest_close, arg_max(price_change_rate, window_end) AS latest_change, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM flagged GROUP BY 1")
def _(s, d):
    return dashboard.summary(flagged(s, d))


@query("dsh18_histogram", f"WITH {SCORED_SQL} SELECT is_truth, CASE WHEN anomaly_score < -1 THEN 0 ELSE least(CAST(floor((anomaly_score + 1) * 50) AS BIGINT) + 1, 51) END AS bin, count(*) AS n FROM flagged GROUP BY 1, 2")
def _(s, d):
    return dashboard.score_histogram(flagged(s, d), -1.0, 0.0, 50, "anomaly_score")


@query("dsh19_key_points", f"WITH {SCORED_SQL} SELECT ticker, window_end, price, volume, lstm_ae FROM flagged WHERE is_anomaly OR is_truth")
def _(s, d):
    return dashboard.key_points(flagged(s, d), list(WEIGHTS))
