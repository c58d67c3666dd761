"""Queries of whole live paths: streams that meet, keyed sinks, pollers, and the fit of the sequence model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.functions import scalars as S
from tidewater.operators import lstm, seen, sequence
from tidewater.scratch import scratch
from tidewater.session import table
from tidewater.sources import market, readers
from tidewater.sources.market import NEWS_SQL, TICKS_SQL
from tidewater.sources.poller import TableService, polled
from tidewater.sources.tables import open_tables, scored_batch
from tidewater.streaming import live, pipeline

from .base import CEP, ENRICHED_SQL, MINUTES, SCORED_SQL, SIZE, enriched, flagged, query, ticks
from .models import EWMA_SQL, WINNER_SQL

DAY = 86_400_000
#: Windows that both streams have passed by a day.
PASSED_SQL = f"(SELECT least(t, n) - {DAY} FROM (SELECT max(ts) AS t FROM ticks), (SELECT max(ts) AS n FROM news))"


def in_parts(rows: DataFrame, parts: int, late_hours: int = 20) -> list[DataFrame]:
    """Rows of a stream as they arrive: a part for each stretch of time, but every row up to so many hours late, by its hash."""
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return [rows]
    late = F.pmod(F.xxhash64("event_id", F.lit(7)), F.lit(late_hours * 3_600_000)) if late_hours else F.lit(0)
    arrival = F.col("ts") + late - first
    part = F.least(F.floor(arrival / ((last - first) // parts + 1)), F.lit(parts - 1))
    return [rows.where(part == k) for k in range(parts)]


def streamed(s: SparkSession, d: str, build, parts: int = 3) -> DataFrame:
    """What a stream over ticks and news gives, run once for each part of them from the checkpoint of the run before."""
    live.use_state_store(s)
    timed = lambda rows: rows.withColumn("time", S.from_epoch_millis("ts"))
    sides = {"ticks": timed(ticks(s, d)), "news": timed(market.news(s, d))}
    source, out, state = scratch(s, "live"), scratch(s, "live-out"), scratch(s, "checkpoint")
    arriving = [in_parts(rows, parts) for rows in sides.values()]
    stream = None
    for k, pair in enumerate(zip(*arriving, strict=True)):
        for name, rows in zip(sides, pair, strict=True):
            rows.write.parquet(f"{source}/{name}/part={k}")
        stream = build(*(s.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{source}/{name}") for name, rows in sides.items()))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


@query("str04_live_enrichment", f"WITH {ENRICHED_SQL} SELECT ticker, window_end, total_volume, avg_sentiment, sentiment_shift, headline_count FROM enriched WHERE window_end <= {PASSED_SQL}")
def _(s, d):
    """Ticks and news as two streams, out of order and over restarts: the same rows as the join of the tables."""
    rows = streamed(s, d, lambda t, n: live.enriched(t, n, MINUTES, "1 day"))
    return rows.select("ticker", "window_end", "total_volume", "avg_sentiment", "sentiment_shift", "headline_count")


@query("str04_live_alerts", f"WITH RECURSIVE {WINNER_SQL}, {EWMA_SQL.removeprefix(ENRICHED_SQL + ', ')} SELECT ticker, window_end, ewma, cep, cep_match FROM winner JOIN ew USING (ticker, window_end) WHERE window_end <= {PASSED_SQL}")
def _(s, d):
    """The whole live path: ticks to windows, news beside them, detectors and patterns on what comes out."""
    rows = streamed(s, d, lambda t, n: live.alerts(t, n, MINUTES, "1 day", s=CEP))
    return rows.select("ticker", "window_end", "ewma", "cep", "cep_match")


@query(
    "snk03_keyed_batches",
    f"""WITH {SCORED_SQL} SELECT ticker, window_end, anomaly_score - CASE WHEN ticker = 'T0' THEN 1 WHEN ticker = 'T1' THEN 2 ELSE 0 END AS anomaly_score, is_anomaly AS alerted,
  CAST(window_end // {DAY} AS BIGINT) AS day_number FROM flagged""",
)
def _(s, d):
    """Batches that come again, repeat keys, or come from a second stream: every key once, with its last value."""
    tables = open_tables(s, scratch(s, "tables"))
    rows = flagged(s, d).select("ticker", "window_end", "price_change_rate", "total_volume", "avg_sentiment", "sentiment_shift", "anomaly_score", "is_anomaly", "detector_scores")
    lowered = lambda by: F.col("anomaly_score") - F.lit(float(by))
    first, second = scored_batch(tables, "first"), scored_batch(tables, "second")
    even = F.floor(F.col("window_end") / DAY) % 2 == 0
    first(rows.where(even), 0)
    first(rows.where(even).withColumn("anomaly_score", lowered(9)), 0)  # again: nothing changes
    first(rows.where(~even).unionByName(rows.where("ticker = 'T0'").withColumn("anomaly_score", lowered(1))).where("ticker != 'T0' or anomaly_score < -1"), 1)
    first(rows.where("ticker = 'T0'").withColumn("anomaly_score", lowered(1)), 2)
    second(rows.where("ticker = 'T1'").withColumn("anomaly_score", lowered(2)), 0)
    alerts = tables["anomaly_alerts"].read().select("ticker", F.col("detected_at").alias("window_end"), F.lit(True).alias("alerted"))
    out = tables["feature_vectors"].read().join(alerts, ["ticker", "window_end"], "left")
    at = F.unix_millis("window_end")
    return out.select("ticker", at.alias("window_end"), "anomaly_score", F.coalesce("alerted", F.lit(False)).alias("alerted"), F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("day_number"))


def fitted_lstm(s: SparkSession, d: str):
    return lstm.fit_lstm(enriched(s, d), ["window_end"], batch=128, epochs=10)


@query("trn02_lstm_fit")
def _(s, d):
    """The mean squared error of every epoch."""
    return s.createDataFrame(list(enumerate(fitted_lstm(s, d)[1])), "epoch int, loss double")


@query(
    "det04_src10_lstm",
    f"WITH {ENRICHED_SQL} SELECT ticker, window_end, row_number() OVER (PARTITION BY ticker ORDER BY window_end) <= 12 AS silent, TRUE AS in_range, TRUE AS the_same FROM enriched",
)
def _(s, d):
    """Fitted, saved and loaded: silent until the buffer is full, then an error between -1 and 0, the same from both models."""
    fitted, path = fitted_lstm(s, d)[0], scratch(s, "lstm")
    lstm.save_lstm(s, fitted, path)
    scores = lambda model, name: sequence.replay(enriched(s, d), ["window_end"], CEP, autoencoder=model).select("ticker", "window_end", F.col("lstm_ae").alias(name))
    both = scores(fitted, "one").join(scores(lstm.load_lstm(s, path), "two"), ["ticker", "window_end"])
    return both.select("ticker", "window_end", (F.col("one") == 0).alias("silent"), F.col("one").between(-1, 0).alias("in_range"), (F.col("one") == F.col("two")).alias("the_same"))


def prices(batch: pa.RecordBatch) -> Iterator[tuple[str, int, tuple]]:
    """Price ticks as a service gives them: (ticker, time, row), the row in order of event_id."""
    for e in batch.to_pylist():
        if e["event_type"] in ("view", "click", "purchase"):
            ticker, at = f"T{e['user_id'] % 5}", pa.scalar(e["ts"], pa.timestamp("ms")).value
            close = (int(e["value"] * 100 + 0.5) * 2 + 1_000_000) / 10_000
            yield ticker, at, (e["event_id"], ticker, at, close, json.loads(e["props"])["k"])


def headlines(batch: pa.RecordBatch) -> Iterator[tuple[str, int, tuple]]:
    """News items as a service gives them, their content as JSON."""
    for e in batch.to_pylist():
        if e["event_type"] in ("error", "signup"):
            ticker, at = f"T{e['user_id'] % 5}", pa.scalar(e["ts"], pa.timestamp("ms")).value
            content = {"content": {"title": f"{e['event_type']} {e['user_id']}", "provider": {"displayName": "wire"} if e["event_id"] % 2 else "desk"}}
            yield ticker, at, (e["event_id"], ticker, at, json.dumps(content))


def polled_table(s: SparkSession, d: str, name: str, rows: Callable, schema: str, latest_only: bool) -> DataFrame:
    """What a poller of the events gives, a poll every six hours, twenty a batch; the stream is stopped half-way and started again."""
    first, last = table(s, d, "events").agg(F.min(S.to_epoch_millis("ts")), F.max(S.to_epoch_millis("ts"))).first()
    size = MINUTES * 60_000
    start, end = (first - 1) // size * size, -(-last // size) * size
    folder = scratch(s, name)
    for known in (start + (end - start) // 2, end):
        service = TableService(f"{d}/events.parquet", "ts", rows, known, latest_only)
        stream = polled(s, name, service, schema, list(SETTINGS.tickers), f"{folder}/cursor", start, size, 20)
        running = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    return s.read.schema(schema).parquet(f"{folder}/out")


@query("src01_polled_bars", f"WITH {TICKS_SQL} SELECT ticker, max(ts) AS ts, arg_max(close, ts * 1000000 + event_id) AS close, arg_max(volume, ts * 1000000 + event_id) AS volume FROM ticks GROUP BY ticker, (ts - 1) // {SIZE}")
def _(s, d):
    """The latest bar of every ticker at every poll, over a restart."""
    return polled_table(s, d, "polled_bars", prices, "event_id long, ticker string, ts long, close double, volume long", True).drop("event_id")


@query("src02_polled_news", f"WITH {NEWS_SQL} SELECT n.event_id, n.ticker, n.ts, e.event_type || ' ' || CAST(e.user_id AS VARCHAR) AS title, CASE WHEN n.event_id % 2 = 1 THEN 'wire' ELSE 'desk' END AS publisher FROM news n JOIN events e USING (event_id)")
def _(s, d):
    """Every news item once, over a restart, with its title and publisher."""
    return readers.news_items(polled_table(s, d, "polled_news", headlines, "event_id long, ticker string, ts long, item string", False)).drop("item")


#: Titles of news that come again, also after more than 1,000 others.
TITLED_SQL = "items AS (SELECT event_id, epoch_us(ts) // 1000 AS ts, 'user ' || CAST(user_id AS VARCHAR) || ' ' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS title FROM events WHERE event_type IN ('error', 'signup'))"
SEEN_SQL = f"""WITH RECURSIVE {TITLED_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM items),
m AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS seen, NULL::BIGINT AS event_id, FALSE AS fresh UNION ALL
  SELECT i.rn, CASE WHEN list_contains(m.seen, i.title) THEN m.seen WHEN len(m.seen) >= 1000 THEN list_append(m.seen[2:], i.title) ELSE list_append(m.seen, i.title) END, i.event_id, NOT list_contains(m.seen, i.title)
  FROM m JOIN numbered i ON i.rn = m.rn + 1) SELECT event_id, fresh FROM m WHERE rn > 0"""


def titled(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 10
    rows = table(s, d, "events").where(F.col("event_type").isin("error", "signup"))
    return rows.select("event_id", S.to_epoch_millis("ts").alias("ts"), F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), k.cast("string")).alias("title"))


@query("flt10_bounded_first_seen", SEEN_SQL)
def _(s, d):
    return seen.seen_lately(titled(s, d), ["ts", "event_id"], block=2048).select("event_id", "fresh")


@query("flt10_bounded_first_seen_stream", SEEN_SQL)
def _(s, d):
    """The same memory kept by a stream from micro-batch to micro-batch, over two restarts."""
    source, out, state = scratch(s, "titles"), scratch(s, "fresh"), scratch(s, "checkpoint")
    rows = titled(s, d)
    for k, part in enumerate(in_parts(rows, 3, 0)):
        part.write.parquet(f"{source}/part={k}")
        stream = s.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(source)
        pipeline.run_available(stream, pipeline.seen_lately(f"{out}/rows", f"{out}/memory"), state)
    return s.read.schema("event_id long, fresh boolean").option("recursiveFileLookup", "true").parquet(f"{out}/rows")
