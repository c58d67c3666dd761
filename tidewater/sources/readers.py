"""Sources: files with given schemas, topics, databases, and the parsing of what arrives on them."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.functions.scalars import rounded
from tidewater.schemas import RAW_NEWS, RAW_PRICES, STREAM_FEATURES

T = TypeVar("T")


def with_retry(fetch: Callable[..., T], *args, attempts: int = 3, most_seconds: float = 60, sleep: Callable[[float], None] = time.sleep) -> T | None:
    """Calls an outside service up to `attempts` times, waiting min(2**k * 5, most_seconds) after failure k; None if all fail."""
    for k in range(attempts):
        try:
            return fetch(*args)
        except Exception:  # noqa: BLE001  whatever the service raises
            if k + 1 < attempts:
                sleep(min(2**k * 5, most_seconds))
    return None


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """A topic as a stream of key and value strings; needs Spark's Kafka package on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()
    return stream.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def file_source(spark: SparkSession, path: str, schema: str, kind: str = "json", files_a_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).load(path)


def parsed(values: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON messages as columns; what can't be parsed goes on in `_corrupt` and stops nothing."""
    message = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return values.withColumn("_m", message).select("_m.*")


def prices(values: DataFrame) -> DataFrame:
    rows = parsed(values, RAW_PRICES)
    return rows.withColumn("time", F.to_timestamp("timestamp"))


def news(values: DataFrame) -> DataFrame:
    rows = parsed(values, RAW_NEWS)
    return rows.withColumn("time", F.to_timestamp("timestamp"))


def stream_features(values: DataFrame) -> DataFrame:
    return parsed(values, STREAM_FEATURES)


def latest_bar(bars: DataFrame, tie: str | None = None) -> DataFrame:
    """The last bar of every ticker, prices to four digits; of bars of one time that with the greatest `tie`, or else the greatest of all by its columns."""
    rest = [c for c in bars.columns if c not in ("ticker", "time", tie)]
    last = bars.groupBy("ticker").agg(F.max_by(F.struct("time", *rest), F.struct("time", *([tie] if tie else []), *rest)).alias("b"))
    return last.select("ticker", "b.time", *(rounded(f"b.{c}", 4).alias(c) if c != "volume" else F.col("b.volume").cast("long").alias("volume") for c in rest))


def news_items(raw: DataFrame, column: str = "item") -> DataFrame:
    """Titles and publishers of raw news items (JSON): the fields may stand in `content` or at the top; blank titles go.

    A publisher is provider.displayName, or the provider itself, or "unknown".
    """
    item = F.coalesce(F.get_json_object(column, "$.content"), F.col(column))
    title = F.trim(F.get_json_object(item, "$.title"))
    source = F.coalesce(F.get_json_object(item, "$.provider.displayName"), F.get_json_object(item, "$.provider"), F.lit("unknown"))
    return raw.select("*", title.alias("title"), source.alias("publisher")).where(F.coalesce(title, F.lit("")) != "")


def ohlcv(spark: SparkSession, path: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from parquet; Datetime or Date becomes timestamp, and the filters reach the scan."""
    bars = spark.read.parquet(path)
    for name in ("Datetime", "Date"):
        if name in bars.columns:
            bars = bars.withColumnRenamed(name, "timestamp")
    if tickers:
        bars = bars.where(F.col("ticker").isin(tickers))
    if start:
        bars = bars.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    return bars.where(F.col("timestamp") < F.lit(end).cast("timestamp")) if end else bars


def union_bars(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database; needs its JDBC driver on the class path."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def bounded_first_seen(titles: list[str], most: int = SETTINGS.seen_titles, seen: dict | None = None) -> list[bool]:
    """Whether each title is new to a memory of the last `most` new ones, over all tickers.  A repeat doesn't refresh its place."""
    seen = {} if seen is None else seen
    out = []
    for t in titles:
        out.append(t not in seen)
        if out[-1]:
            seen[t] = None
            if len(seen) > most:
                del seen[next(iter(seen))]
    return out
