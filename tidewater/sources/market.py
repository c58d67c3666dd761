"""The market tables that the engine works on, mapped from the test data.

`events` of types view, click and purchase are price ticks of one of five tickers, those of types error
and signup are scored news.  Prices are exact ten-thousandths, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.scalars import to_epoch_millis
from tidewater.session import table

WINDOW_HOURS = 6


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def _ticker() -> Column:
    return F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ts (epoch ms), event_id, close_e4, close, volume."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    close_e4 = F.floor(F.col("value") * 100 + F.lit(0.5)) * 2 + 1_000_000
    return events.select(_ticker().alias("ticker"), to_epoch_millis("ts").alias("ts"), "event_id", close_e4.alias("close_e4"), (close_e4 / F.lit(10000.0)).alias("close"), _k().alias("volume"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ts (epoch ms), event_id, score_c (hundredths), score, label."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    score = F.when(F.col("event_type") == "error", -_k()).otherwise(_k())
    label = F.when(_k() == 0, "neutral").when(F.col("event_type") == "error", "negative").otherwise("positive")
    return events.select(_ticker().alias("ticker"), to_epoch_millis("ts").alias("ts"), "event_id", score.alias("score_c"), (score / F.lit(100.0)).alias("score"), label.alias("label"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (an order priority), day (days since 1970), close (mean price, from exact cents), volume."""
    orders = table(spark, sf_dir, "orders")
    cents = F.floor(F.col("o_totalprice") * 100 + F.lit(0.5))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    bars = orders.select(F.col("o_orderpriority").alias("ticker"), day.alias("day"), cents.alias("cents"))
    return bars.groupBy("ticker", "day").agg((F.sum("cents") / F.count(F.lit(1)) / F.lit(100.0)).alias("close"), F.count(F.lit(1)).alias("volume"))


#: The same tables as SQL that DuckDB runs.
TICKS_SQL = """ticks AS (SELECT 'T' || CAST(user_id % 5 AS VARCHAR) AS ticker, epoch_us(ts) // 1000 AS ts, event_id,
  CAST(floor(value * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) * 2 + 1000000 AS close_e4,
  (CAST(floor(value * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) * 2 + 1000000) / CAST(10000 AS DOUBLE) AS close,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume
  FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
NEWS_SQL = """news AS (SELECT 'T' || CAST(user_id % 5 AS VARCHAR) AS ticker, epoch_us(ts) // 1000 AS ts, event_id, s AS score_c, s / CAST(100 AS DOUBLE) AS score,
  CASE WHEN s = 0 THEN 'neutral' WHEN event_type = 'error' THEN 'negative' ELSE 'positive' END AS label
  FROM (SELECT *, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * CAST(json_extract_string(props, '$.k') AS BIGINT) AS s FROM events WHERE event_type IN ('error', 'signup')))"""
BARS_SQL = """bars AS (SELECT o_orderpriority AS ticker, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day,
  CAST(sum(CAST(floor(o_totalprice * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / count(*) / CAST(100 AS DOUBLE) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2)"""
