"""As-of enrichment without a range join: news and features meet in one sorted union per ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.functions.scalars import rounded


def sentiment_state(news: DataFrame, total: int = SETTINGS.sentiment_rows, recent: int = SETTINGS.sentiment_recent) -> DataFrame:
    """What the latest `total` news of a ticker say once a row of news is in: sums and counts of the recent and the older part."""
    w = Window.partitionBy("ticker").orderBy("ts", "event_id")
    new, old = w.rowsBetween(1 - recent, 0), w.rowsBetween(1 - total, -recent)
    state = F.struct(
        F.sum("score_c").over(new).alias("new_sum"),
        F.count("score_c").over(new).alias("new_n"),
        F.sum("score_c").over(old).alias("old_sum"),
        F.count("score_c").over(old).alias("old_n"),
    )
    return news.select("ticker", "ts", "event_id", state.alias("state"))


def sentiment_columns(new_sum: str, new_n: str, old_sum: str, old_n: str) -> list[Column]:
    """avg_sentiment, sentiment_shift and headline_count from sums (in hundredths) and counts of the recent and the older scores."""
    new = F.col(new_sum) / F.lit(100.0) / F.col(new_n)
    old = F.when(F.col(old_n) > 0, F.col(old_sum) / F.lit(100.0) / F.col(old_n)).otherwise(new)
    new, old = (F.when(F.col(new_n) > 0, x) for x in (new, old))
    return [
        F.coalesce(rounded(new, 4), F.lit(0.0)).alias("avg_sentiment"),
        F.coalesce(rounded(new - old, 4), F.lit(0.0)).alias("sentiment_shift"),
        F.coalesce(F.col(new_n), F.lit(0)).alias("headline_count"),
    ]


def enrich(features: DataFrame, news: DataFrame, total: int = SETTINGS.sentiment_rows, recent: int = SETTINGS.sentiment_recent) -> DataFrame:
    """Adds avg_sentiment, sentiment_shift and headline_count as of window_end; news at that very time count.

    The mean of the latest `recent` scores, its difference to the mean of those before (of `total` in all;
    no difference if there are none), and how many there were.  Zeros without news.
    """
    left = features.withColumns({"_at": F.col("window_end"), "_side": F.lit(1)})
    right = sentiment_state(news, total, recent).select("ticker", F.col("ts").alias("_at"), "event_id", "state", F.lit(0).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("_at", "_side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_state", F.last("state", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*features.columns, *sentiment_columns("_state.new_sum", "_state.new_n", "_state.old_sum", "_state.old_n"))


def anchored(features: DataFrame, events: DataFrame, reach: int = 2) -> DataFrame:
    """For each event (ticker, day) the row it is about: of the rows within `reach` of the nearest day the one with the largest absolute change.

    Ties go to the earlier row.  `events` is a short list (an analyst's), its size checked before it is broadcast.
    """
    if events.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 events")
    w = Window.partitionBy("ticker").orderBy("day")
    rows = features.select("ticker", "day", "price_change_rate", F.row_number().over(w).alias("rn"))
    wanted = F.broadcast(events.select("ticker", F.col("day").alias("event_day")))
    nearest = rows.join(wanted, "ticker").groupBy("ticker", "event_day").agg(F.min_by("rn", F.struct(F.abs(F.col("day") - F.col("event_day")), "rn")).alias("near"))
    band = nearest.select("ticker", "event_day", F.explode(F.sequence(F.col("near") - reach, F.col("near") + reach)).alias("rn"))
    band = rows.join(F.broadcast(band), ["ticker", "rn"])
    return band.groupBy("ticker", "event_day").agg(F.max_by(F.struct("day", "price_change_rate"), F.struct(F.abs("price_change_rate"), -F.col("rn"))).alias("x")).select("ticker", "event_day", "x.day", "x.price_change_rate")
