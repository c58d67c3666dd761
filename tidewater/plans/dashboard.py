"""The dashboard's questions.  `asof` (epoch ms) stands for now, so that answers can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.functions.scalars import freshness, severity
from tidewater.operators.ensemble import agreement

HOUR = 3_600_000


def since(time: str, hours: float, asof: Column | int) -> Column:
    return F.col(time) > asof - F.lit(int(hours * HOUR))


def one_ticker(df: DataFrame, ticker: str | None) -> DataFrame:
    """All tickers for None or "All"."""
    return df if ticker in (None, "All") else df.where(F.col("ticker") == ticker)


def price_history(features: DataFrame, ticker: str, hours: float, asof: int) -> DataFrame:
    return features.where((F.col("ticker") == ticker) & since("window_end", hours, F.lit(asof))).select("window_end", "avg_close", "total_volume", "price_change_rate").orderBy("window_end")


def latest_news(news: DataFrame, ticker: str, n: int = 50) -> DataFrame:
    return news.where(F.col("ticker") == ticker).orderBy(F.desc("ts"), F.desc("event_id")).limit(n).select("ts", "event_id", "score", "label")


def recent_alerts(alerts: DataFrame, ticker: str | None = None, n: int = 50, high: float = SETTINGS.severity_high) -> DataFrame:
    """The latest alerts, each beside the totals of the selection; the totals are scalar subqueries, which Catalyst merges into one pass."""
    chosen = one_ticker(alerts, ticker)
    latest = chosen.orderBy(F.desc("ts"), "ticker").limit(n).withColumn("severity", severity("score", high))
    text = """SELECT *, (SELECT count(*) FROM {chosen}) AS total, (SELECT count_if(score < :high) FROM {chosen}) AS high, (SELECT count_if(score >= :high) FROM {chosen}) AS normal FROM {latest}"""
    return alerts.sparkSession.sql(text, args={"high": high}, chosen=chosen, latest=latest)


def model_versions(registry: DataFrame, n: int = 20) -> DataFrame:
    return registry.orderBy(F.desc("trained_at"), F.desc("version"), "model_name").limit(n)


def in_lookback(df: DataFrame, time: str, hours: float, asof: int, ticker: str | None = None) -> DataFrame:
    return one_ticker(df, ticker).where(since(time, hours, F.lit(asof)))


def detector_scores(features: DataFrame, hours: float, asof: int, ticker: str | None = None) -> DataFrame:
    rows = in_lookback(features, "window_end", hours, asof, ticker).where(F.col("detector_scores").isNotNull())
    return rows.select("ticker", "window_end", "anomaly_score", "detector_scores").orderBy("window_end", "ticker")


def hourly_rate(features: DataFrame, hours: float, asof: int) -> DataFrame:
    rows = in_lookback(features, "window_end", hours, asof)
    hour = (F.col("window_end") - F.pmod(F.col("window_end"), F.lit(HOUR))).alias("hour")
    counts = rows.groupBy(hour).agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("is_anomaly"), 1).otherwise(0)).alias("anomalies"))
    return counts.withColumn("rate", F.col("anomalies") / F.col("total"))


def health(df: DataFrame, time: str, asof: int, hours: float = 24) -> DataFrame:
    """Per ticker the latest time and the rows of the last `hours`."""
    return df.groupBy("ticker").agg(F.max(time).alias("latest"), F.count_if(since(time, hours, F.lit(asof))).alias("recent"))


def alert_totals(alerts: DataFrame, asof: int, hours: float = 24) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("total"), F.count_if(since("ts", hours, F.lit(asof))).alias("recent"))


def compare(df: DataFrame, tickers: list[str], time: str, hours: float, asof: int, *columns: str) -> DataFrame:
    return df.where(F.col("ticker").isin(tickers) & since(time, hours, F.lit(asof))).select("ticker", time, *columns)


def status(tickers: DataFrame, features: DataFrame, asof: int) -> DataFrame:
    """Every ticker of the list with its age in minutes and status, also those without data."""
    latest = features.groupBy("ticker").agg(F.max("window_end").alias("latest"))
    rows = tickers.join(latest, "ticker", "left").withColumn("age_minutes", (F.lit(asof) - F.col("latest")) / F.lit(60000.0))
    return rows.select("ticker", "latest", "age_minutes", freshness("age_minutes").alias("status"))


def summary(features: DataFrame) -> DataFrame:
    """Per ticker the latest price and change, and how many windows were anomalies."""
    return features.groupBy("ticker").agg(F.max_by("avg_close", "window_end").alias("latest_close"), F.max_by("price_change_rate", "window_end").alias("latest_change"), F.count_if("is_anomaly").alias("anomalies"))


def label_mix(news: DataFrame) -> DataFrame:
    count = lambda label: F.count_if(F.col("label") == label).alias(label)
    return news.groupBy("ticker").agg(count("positive"), count("negative"), count("neutral"), (F.sum("score_c") / F.count(F.lit(1)) / F.lit(100.0)).alias("mean_score"))


def expanded(features: DataFrame, names: list[str]) -> DataFrame:
    """A column for each detector."""
    return features.select("ticker", "window_end", *(F.col("detector_scores")[n].alias(n) for n in names))


def vote_shares(features: DataFrame, vote: float = -0.3) -> DataFrame:
    return features.select("ticker", "window_end", agreement(F.col("detector_scores"), vote).alias("agreement"))


def drift_timeline(drifts: DataFrame) -> DataFrame:
    return drifts.select("ticker", "window_end", F.explode("drifted").alias("feature"))


def score_histogram(scored: DataFrame, low: float, high: float, bins: int, score: str = "score") -> DataFrame:
    """Rows of each of `bins` equal steps from low to high, by whether they are anomalies; outside: bins 0 and bins + 1."""
    return scored.groupBy("is_truth", F.width_bucket(F.col(score), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def key_points(scored: DataFrame, names: list[str]) -> DataFrame:
    """The detectors' scores of the rows that are flagged or true."""
    return scored.where(F.col("is_anomaly") | F.col("is_truth")).select("ticker", "window_end", *(F.col("detector_scores")[n].alias(n) for n in names))
