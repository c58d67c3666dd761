"""Window features: tumbling by time, sliding by rows, daily; and the row frames that detectors need.

All are native plans.  Tumbling features are one partial and one final aggregate; the row frames share one
shuffle by ticker.  The order inside a ticker is total: time, then event id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.functions.scalars import price_change_rate, rounded


def tumbling_features(ticks: DataFrame, minutes: int = SETTINGS.window_minutes) -> DataFrame:
    """One row per ticker and non-empty window of epoch-aligned `minutes`; first and last by arrival (ts, event_id)."""
    size = minutes * 60_000
    start = F.expr(f"ts - pmod(ts, {size})")
    order = F.struct("ts", "event_id")
    grouped = ticks.groupBy("ticker", start.alias("window_start")).agg(
        F.sum("close_e4").alias("sum_e4"),
        F.min_by("close", order).alias("first_close"),
        F.max_by("close", order).alias("last_close"),
        F.sum("volume").alias("total_volume"),
        F.count(F.lit(1)).alias("tick_count"),
    )
    return grouped.select(
        "ticker",
        "window_start",
        (F.col("window_start") + size).alias("window_end"),
        rounded(F.col("sum_e4") / F.col("tick_count") / F.lit(10000.0), 4).alias("avg_close"),
        rounded("first_close", 4).alias("first_close"),
        rounded("last_close", 4).alias("last_close"),
        price_change_rate("first_close", "last_close").alias("price_change_rate"),
        "total_volume",
        "tick_count",
    )


def by_time(*extra: str):
    return Window.partitionBy("ticker").orderBy("ts", *(extra or ("event_id",)))


def sliding_features(ticks: DataFrame, size: int = 5) -> DataFrame:
    """Windows of `size` rows, one for each row but the first size - 1 and the last: n - size in all.

    The window that ends at a ticker's last row is never emitted.
    """
    rows = by_time().rowsBetween(-(size - 1), 0)
    count = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    framed = ticks.select(
        "ticker",
        "ts",
        "event_id",
        F.row_number().over(by_time()).alias("rn"),
        count.alias("n"),
        F.first("close").over(rows).alias("first_close"),
        "close",
        F.sum("close_e4").over(rows).alias("sum_e4"),
        F.sum("volume").over(rows).alias("total_volume"),
    )
    return framed.where((F.col("rn") >= size) & (F.col("rn") < F.col("n"))).select(
        "ticker",
        "ts",
        "event_id",
        rounded(F.col("sum_e4") / F.lit(size) / F.lit(10000.0), 4).alias("avg_close"),
        price_change_rate("first_close", "close").alias("price_change_rate"),
        "total_volume",
    )


def with_seeded_sentiment(features: DataFrame, seed: int = SETTINGS.seed) -> DataFrame:
    """Synthetic sentiment for histories without news: N(0, 0.15) and N(0, 0.08), from a hash of the row's number, the same for every ticker."""
    n = F.row_number().over(by_time())

    def normal(stream: int, scale: float):
        unit = lambda k: (F.pmod(F.xxhash64(n, F.lit(seed), F.lit(k)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return rounded(F.sqrt(-2 * F.log(unit(2 * stream))) * F.cos(F.lit(6.283185307179586) * unit(2 * stream + 1)) * scale, 4)

    return features.withColumns({"avg_sentiment": normal(0, 0.15), "sentiment_shift": normal(1, 0.08)})


def daily_features(bars: DataFrame) -> DataFrame:
    """Returns on the day before; the first day of a ticker goes.  Sentiment is neutral."""
    w = Window.partitionBy("ticker").orderBy("day")
    rows = bars.withColumn("previous", F.lag("close").over(w)).where("previous is not null")
    change = F.when(F.col("previous") == 0, F.lit(0.0)).otherwise(rounded((F.col("close") - F.col("previous")) / F.col("previous"), 6))
    return rows.select("ticker", "day", "close", change.alias("price_change_rate"), F.col("volume").alias("total_volume"), F.lit(0.0).alias("avg_sentiment"), F.lit(0.0).alias("sentiment_shift"))


def last_rows(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Each ticker's last k rows."""
    w = Window.partitionBy("ticker").orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def sequences(df: DataFrame, value: str, length: int = SETTINGS.sequence_length, order: tuple[str, ...] = ("window_start",)) -> DataFrame:
    """Every full run of `length` consecutive values of a ticker, ending at the current row: n - length + 1 of them."""
    w = Window.partitionBy("ticker").orderBy(*order)
    rows = df.withColumns({"sequence": F.collect_list(value).over(w.rowsBetween(1 - length, 0)), "_rn": F.row_number().over(w)})
    return rows.where(F.col("_rn") >= length).drop("_rn")


def buffers(df: DataFrame, value: str, length: int = SETTINGS.sequence_length, order: tuple[str, ...] = ("window_start",)) -> DataFrame:
    """What a score sees: the `length` values before the current row."""
    return df.withColumn("buffer", F.collect_list(value).over(Window.partitionBy("ticker").orderBy(*order).rowsBetween(-length, -1)))


def temporal_split(df: DataFrame, order: list[str], ratio: float = SETTINGS.train_ratio) -> DataFrame:
    """Adds `is_train`: whether a row is among the first int(n * ratio) of its ticker."""
    w = Window.partitionBy("ticker")
    return df.withColumn("is_train", F.row_number().over(w.orderBy(*order)) <= F.floor(F.count(F.lit(1)).over(w) * F.lit(ratio)))


def neighbourhood(df: DataFrame, events: DataFrame, order: str, reach: int = 2) -> DataFrame:
    """Rows within `reach` rows of each event, an event being (ticker, at) with `at` a value of `order`; adds offset."""
    w = Window.partitionBy("ticker").orderBy(order)
    rows = df.withColumn("_rn", F.row_number().over(w))
    at = rows.join(events, (rows["ticker"] == events["ticker"]) & (rows[order] == events["at"])).select(rows["ticker"], F.col("_rn").alias("_at"), "at")
    near = at.select("ticker", "at", "_at", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("_rn", F.col("_at") + F.col("offset"))
    return rows.join(near.select("ticker", "at", "offset", "_rn"), ["ticker", "_rn"]).drop("_rn")


def first_seen(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key, over all tickers."""
    w = Window.partitionBy(key).orderBy(*order)
    return items.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
