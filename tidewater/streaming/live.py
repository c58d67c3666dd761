"""Ticks and news as two streams to windows with the sentiment of their time, and on to scores.

Both streams meet in one tagged union, keyed by ticker.  A window waits for the watermark to pass its end, as news of that
very time count; an event-time timer says when.  The state of a key is typed: the news that no window has reached yet (of
the time that the watermark lags, and of one window at most), the latest scores before, and the windows that wait.
Rows behind the watermark are dropped by Spark, on either side; the watermark is that of the slower stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.config import FEATURES, SETTINGS, Settings
from tidewater.functions.scalars import price_change_rate, rounded, to_epoch_millis
from tidewater.operators.enrich import sentiment_columns

from .pipeline import scored

#: What a window carries through, and what the news of its time add up to.
CARRIED = ("avg_close", "first_close", "last_close", "price_change_rate", "total_volume", "tick_count")
_KINDS = "avg_close double, first_close double, last_close double, price_change_rate double, total_volume long, tick_count long"
_SUMS = "new_sum long, new_n long, old_sum long, old_n long"
OUT = f"time timestamp, ticker string, window_start long, window_end long, {_KINDS}, {_SUMS}"
STORE = "spark.sql.streaming.stateStore.providerClass"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers lives in RocksDB."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sums_of(scores: list[int], recent: int) -> tuple[int, int, int, int]:
    """Sums and counts of the latest `recent` of some scores in order, and of those before."""
    new, old = scores[-recent:], scores[:-recent]
    return sum(new), len(new), sum(old), len(old)


class AsOf(StatefulProcessor):
    """Gives every window of a ticker what its latest news said at its end."""

    def __init__(self, total: int = SETTINGS.sentiment_rows, recent: int = SETTINGS.sentiment_recent) -> None:
        self.total, self.recent = total, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getListState("latest", "score_c long")
        self.ahead = handle.getListState("ahead", "ts long, event_id long, score_c long")
        self.waiting = handle.getListState("waiting", f"window_start long, window_end long, {_KINDS}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            said = pdf[pdf["kind"] == 0]
            if len(said):
                self.ahead.appendList([tuple(map(int, r)) for r in said[["at", "event_id", "score_c"]].itertuples(index=False)])
            windows = pdf[pdf["kind"] == 1]
            if len(windows):
                floats, wholes = CARRIED[:4], CARRIED[4:]
                self.waiting.appendList([(int(r["window_start"]), int(r["at"]), *(float(r[c]) for c in floats), *(int(r[c]) for c in wholes)) for r in windows.to_dict("records")])
                for end in windows["at"].unique():
                    self.handle.registerTimer(int(end))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The first timer of a batch settles all windows that the watermark has passed; the others find none left."""
        now = timerValues.getCurrentWatermarkInMs()
        windows = sorted(self.waiting.get(), key=lambda w: w[1])
        done = [w for w in windows if w[1] <= now]
        if not done:
            return
        news = sorted(self.ahead.get())
        scores, k, out = [s for (s,) in self.latest.get()], 0, []
        for start, end, *rest in done:
            while k < len(news) and news[k][0] <= end:
                scores.append(news[k][2])
                k += 1
            scores = scores[-self.total :]
            out.append((pd.Timestamp(end, unit="ms"), key[0], start, end, *rest, *sums_of(scores, self.recent)))
        for state, rows in ((self.latest, [(s,) for s in scores]), (self.ahead, news[k:]), (self.waiting, windows[len(done) :])):
            if rows:
                state.put([tuple(r) for r in rows])
            else:
                state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def windows(ticks: DataFrame, minutes: int, late: str) -> DataFrame:
    """Tumbling features of a stream of ticks as rows of the union: kind 1, at the window's end."""
    order = F.struct("ts", "event_id")
    grouped = ticks.withWatermark("time", late).groupBy("ticker", F.window("time", f"{minutes} minutes").alias("w"))
    rows = grouped.agg(F.sum("close_e4").alias("sum_e4"), F.min_by("close", order).alias("first_close"), F.max_by("close", order).alias("last_close"), F.sum("volume").alias("total_volume"), F.count(F.lit(1)).alias("tick_count"))
    return rows.select(
        F.window_time("w").alias("time"),
        "ticker",
        F.lit(1).alias("kind"),
        to_epoch_millis("w.end").alias("at"),
        F.lit(None).cast("long").alias("event_id"),
        F.lit(None).cast("long").alias("score_c"),
        to_epoch_millis("w.start").alias("window_start"),
        rounded(F.col("sum_e4") / F.col("tick_count") / F.lit(10000.0), 4).alias("avg_close"),
        rounded("first_close", 4).alias("first_close"),
        rounded("last_close", 4).alias("last_close"),
        price_change_rate("first_close", "last_close").alias("price_change_rate"),
        "total_volume",
        "tick_count",
    )


def enriched(ticks: DataFrame, news: DataFrame, minutes: int = SETTINGS.window_minutes, late: str = f"{SETTINGS.grace_seconds} seconds", s: Settings = SETTINGS) -> DataFrame:
    """Windows of a stream of ticks with avg_sentiment, sentiment_shift and headline_count as of their ends.

    ticks: time, ticker, ts (epoch ms), event_id, close, close_e4, volume; news: time, ticker, ts, event_id, score_c.  `late`
    is how far behind the latest row of its stream a row may come.  A window comes out once, when both streams are past it.
    """
    left = windows(ticks, minutes, late)
    said = news.where("score_c is not null").withWatermark("time", late).select("time", "ticker", F.lit(0).alias("kind"), F.col("ts").alias("at"), "event_id", "score_c", *(F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields[6:]))
    both = left.unionByName(said).groupBy("ticker")
    out = both.transformWithStateInPandas(AsOf(s.sentiment_rows, s.sentiment_recent), outputStructType=OUT, outputMode="append", timeMode="EventTime", eventTimeColumnName="time")
    return out.select("time", "ticker", "window_start", "window_end", *CARRIED, *sentiment_columns("new_sum", "new_n", "old_sum", "old_n"))


def alerts(ticks: DataFrame, news: DataFrame, minutes: int = SETTINGS.window_minutes, late: str = f"{SETTINGS.grace_seconds} seconds", s: Settings = SETTINGS, **models) -> DataFrame:
    """From ticks and news to scores: enriched windows through the stateful scorer; `models` are a forest and an autoencoder."""
    rows = enriched(ticks, news, minutes, late, s)
    return scored(rows.select("ticker", "window_end", *FEATURES), s=s, **models)
