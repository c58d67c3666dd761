"""Ticks to windows to scores as streams: watermarks, keyed state in the state store, idempotent sinks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewater.config import FEATURES, SETTINGS, Settings
from tidewater.functions.scalars import anomaly_reason, price_change_rate
from tidewater.operators.ensemble import ensemble_score
from tidewater.operators.detectors.autoencoder import Autoencoder
from tidewater.operators.detectors.hst import HalfSpaceTrees
from tidewater.operators.detectors.iforest import IsolationForest
from tidewater.operators.seen import remembered
from tidewater.operators.sequence import BLOCK, REPLAY, Key, with_iforest
from tidewater.scratch import passing

SCORED = f"ticker string, window_end long, price_change_rate double, total_volume double, avg_sentiment double, sentiment_shift double, hst double, {REPLAY}"


def windowed(ticks: DataFrame, minutes: int = SETTINGS.window_minutes, grace: int = SETTINGS.grace_seconds) -> DataFrame:
    """Tumbling features of a stream with time, ticker, close, volume and event_id; later than the grace is dropped.

    In append mode a window comes out once, when the watermark has passed its end.  Batches work as well.
    """
    order = F.struct("time", "event_id")
    grouped = ticks.withWatermark("time", f"{grace} seconds").groupBy("ticker", F.window("time", f"{minutes} minutes").alias("w"))
    rows = grouped.agg(F.avg("close").alias("avg_close"), F.min_by("close", order).alias("first_close"), F.max_by("close", order).alias("last_close"), F.sum("volume").alias("total_volume"), F.count(F.lit(1)).alias("tick_count"))
    return rows.select("ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "avg_close", "first_close", "last_close", price_change_rate("first_close", "last_close").alias("price_change_rate"), "total_volume", "tick_count")


def unseen(items: DataFrame, key: str = "title", time: str = "time", within: str = "1 day") -> DataFrame:
    """The first item of every key within the watermark."""
    return items.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def seen_lately(out: str, state: str, order: tuple[str, ...] = ("ts", "event_id"), most: int = SETTINGS.seen_titles, block: int = BLOCK, halo: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes the items with `fresh`, whether the title isn't among the last `most` that were fresh, to `out`, a folder for each micro-batch.

    A repeat doesn't refresh its place, and a title that was pushed out is fresh again.  Micro-batches come in order, the rows
    of one in any; items without a title go.  The work of a micro-batch is dealt in blocks (`seen.remembered`).  `state` holds
    the memories after the last two, so that one which comes again starts from the same memory and replaces what it wrote.
    """

    def write(batch: DataFrame, n: int) -> None:
        s, memory = batch.sparkSession, None
        if n:
            memory = s.read.schema("batch long, memory binary").parquet(f"{state}/{(n - 1) % 2}").where(F.col("batch") == n - 1)
            if memory.count() != 1:
                raise ValueError(f"{state} doesn't hold the memory after micro-batch {n - 1}")
        with passing(s):
            rows, after = remembered(batch, list(order), most=most, block=block, halo=halo, memory=memory)
            after = s.createDataFrame([(bytearray(b"[]"),)], "memory binary") if after is None else after
            rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
            after.select(F.lit(n).cast("long").alias("batch"), "memory").coalesce(1).write.mode("overwrite").parquet(f"{state}/{n % 2}")

    return write


class Scoring(StatefulProcessor):
    """The kernels of a key live in the state store; a micro-batch's rows are scored and learned in the order of window_end."""

    def __init__(self, settings: Settings = SETTINGS, autoencoder: Autoencoder | None = None) -> None:
        self.settings, self.autoencoder = settings, autoencoder

    def fresh(self) -> tuple[Key, HalfSpaceTrees]:
        s = self.settings
        return Key(s, self.autoencoder), HalfSpaceTrees(s.hst_trees, s.hst_height, s.hst_window, s.seed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("key", "kernels binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kernels, trees = pickle.loads(self.state.get()[0]) if self.state.exists() else self.fresh()
        pdf = pd.concat(list(rows)).sort_values("window_end", kind="stable", ignore_index=True)
        out = []
        for r in pdf.to_dict("records"):
            out.append((r["ticker"], r["window_end"], *(float(r[f] or 0.0) for f in FEATURES), trees.score(r), *kernels.step(r)))
            trees.update(r)
        self.state.update((pickle.dumps((kernels, trees)),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORED.split(", ")])

    def close(self) -> None:
        pass


def scored(features: DataFrame, mode: str = "append", forest: IsolationForest | None = None, autoencoder: Autoencoder | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Scores of a stream (or a batch) of features with ticker, window_end (epoch ms) and the detectors' features; with a forest also its scores.

    The ensemble counts the forest and the autoencoder where they are given.  Half-space trees learn each ticker on its own
    here, as tickers come to different tasks; in `sequence.with_hst` they learn all of them in one order.
    """
    _ = features.sparkSession.streams.active  # a batch needs the state stores' coordinator as well, which this starts
    rows = features.select("ticker", "window_end", *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES))
    out = rows.groupBy("ticker").transformWithStateInPandas(Scoring(s, autoencoder), outputStructType=SCORED, outputMode=mode, timeMode="None")
    names = ["ewma", "hst", "lstm_ae"]
    if forest:
        out, names = with_iforest(out, forest), [*names, "isolation_forest"]
    score = ensemble_score({n: F.col(n) for n in names}, s.weights)
    out = out.withColumn("anomaly_score", score).withColumn("is_anomaly", F.col("anomaly_score") < s.threshold)
    return out.withColumn("reason", anomaly_reason("anomaly_score"))


def run_available(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    """Takes what is there in micro-batches and stops; started again it goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_always(stream: DataFrame, write, checkpoint: str, seconds: int = 30) -> StreamingQuery:
    """A micro-batch every `seconds`; `stop()` ends it between batches."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
