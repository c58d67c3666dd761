from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater.sources import readers
from tidewater.streaming import live, pipeline

MINUTE = 60_000
TICKS = "ticker string, ts long, event_id long, close double, close_e4 long, volume long"
NEWS = "ticker string, ts long, event_id long, score_c long"


def tick(ticker, ts, k=0, close=100.0):
    return (ticker, ts, k, close, int(close * 10_000), 10)


class Feed:
    """Two file streams that are run after each delivery."""

    def __init__(self, spark, folder, **kwargs):
        self.spark, self.folder, self.kwargs, self.n = spark, f"file://{folder}", kwargs, 0
        live.use_state_store(spark)

    def deliver(self, ticks, news):
        streams = []
        for name, rows, schema in (("ticks", ticks, TICKS), ("news", news, NEWS)):
            df = self.spark.createDataFrame(rows, schema).withColumn("time", F.timestamp_millis("ts"))
            df.coalesce(1).write.parquet(f"{self.folder}/{name}/part={self.n}")
            streams.append(self.spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}"))
        self.n += 1
        out = live.enriched(*streams, minutes=1, **self.kwargs)
        out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
        got = self.spark.read.schema(out.schema).parquet(f"{self.folder}/out")
        return {(r["ticker"], r["window_end"] // MINUTE): (r["avg_sentiment"], r["sentiment_shift"], r["headline_count"]) for r in got.collect()}


def test_news_of_the_very_end_count_and_late_ones_do_not(spark, tmp_path):
    feed = Feed(spark, tmp_path, late="30 seconds")
    ticks = [tick("A", 10_000), tick("A", 70_000), tick("B", 20_000)]
    # Nothing is past both streams yet: the news say 50 s, less 30.
    assert feed.deliver(ticks, [("A", 50_000, 1, 40)]) == {}
    # 60,000 is the end of the first window: in; 60,001 is behind it.
    got = feed.deliver([tick("A", 200_000)], [("A", 60_000, 2, 80), ("A", 60_001, 3, -100), ("B", 200_000, 4, 10)])
    assert got == {("A", 1): (0.6, 0.0, 2), ("B", 1): (0.0, 0.0, 0), ("A", 2): (0.0667, 0.0, 3)}
    # The watermark is at 170 s: news of 100 s are dropped, and so is a tick of a window that came out.
    got = feed.deliver([tick("A", 15_000), tick("A", 400_000)], [("A", 100_000, 5, 100), ("A", 180_000, 6, 100), ("A", 400_000, 7, 0)])
    assert got[("A", 4)] == (0.3, 0.0, 4) and len(got) == 4


def test_any_order_of_arrival_gives_what_the_tables_give(spark, tmp_path):
    from tidewater.operators import enrich, features

    rng = random.Random(4)
    ticks = [tick(rng.choice("AB"), rng.randrange(40 * MINUTE), k, 100 + rng.randrange(99) / 7) for k in range(400)]
    news = [(rng.choice("ABC"), rng.randrange(0, 40 * MINUTE, 500), k, rng.randrange(-100, 100)) for k in range(300)]
    want = enrich.enrich(features.tumbling_features(spark.createDataFrame(ticks, TICKS), 1), spark.createDataFrame(news, NEWS))
    want = {(r["ticker"], r["window_end"] // MINUTE): (r["avg_sentiment"], r["sentiment_shift"], r["headline_count"]) for r in want.collect()}
    feed = Feed(spark, tmp_path, late="10 minutes")
    part = lambda rows, low, high: [r for r in rows if low <= r[1] + 1000 * (r[2] * 7919 % 550) < high]
    bounds = [0, 15 * MINUTE, 31 * MINUTE, 99 * MINUTE]
    for low, high in zip(bounds, bounds[1:], strict=False):
        got = feed.deliver(part(ticks, low, high), part(news, low, high))
    passed = min(max(r[1] for r in rows) for rows in (ticks, news)) - 10 * MINUTE
    assert got == {k: v for k, v in want.items() if k[1] * MINUTE <= passed} and len(got) > 40


@pytest.mark.parametrize(("scores", "expected"), [([], (0, 0, 0, 0)), ([1, 2], (3, 2, 0, 0)), ([5, 1, 2, 3], (6, 3, 5, 1))])
def test_sums(scores, expected):
    assert live.sums_of(scores, 3) == expected


def test_a_stream_remembers_in_blocks(spark, tmp_path):
    """Micro-batches of several blocks, of a row and of none; each goes on from the memory before, also where it comes again."""
    rng, folder, most = random.Random(40), f"file://{tmp_path}", 15
    titles = [f"t{int(40 * rng.random() ** 2)}" for _ in range(160)]
    df = spark.createDataFrame([(k // 2, k, t) for k, t in enumerate(titles)] + [(80, 160, None)], "ts long, event_id long, title string").repartition(3)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    left = {name: len(list(shared.glob(f"*/{name}-*"))) for name in ("ranges", "remembered", "settled", "wrong")}
    write = pipeline.seen_lately(f"{folder}/out", f"{folder}/memory", most=most, block=32, halo=8)
    for n, (low, high) in enumerate([(0, 0), (0, 1), (1, 100), (100, 100), (100, 161)]):
        batch = df.where(F.col("event_id").between(low, high - 1))
        for _ in range(1 + (n == 2)):
            write(batch, n)
    got = spark.read.schema("event_id long, title string, fresh boolean").option("recursiveFileLookup", "true").parquet(f"{folder}/out").orderBy("event_id").collect()
    assert [r["title"] for r in got] == titles
    assert [r["fresh"] for r in got] == readers.bounded_first_seen(titles, most)
    assert left == {name: len(list(shared.glob(f"*/{name}-*"))) for name in left}
    with pytest.raises(ValueError, match="micro-batch 6"):
        write(df, 7)


def test_a_stream_of_titles_asks_no_store_for_each(spark, tmp_path):
    """20,000 titles over a restart; no operator keeps them in the state store, where each would take some calls."""
    folder, titles = f"file://{tmp_path}", [f"title {k % 15_000}" if k % 9 else f"title {k % 500}" for k in range(20_000)]
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(titles)], "ts long, event_id long, title string")
    for k in range(2):
        df.where(F.col("ts").between(10_000 * k, 10_000 * k + 9_999)).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        query = pipeline.run_available(stream, pipeline.seen_lately(f"{folder}/out", f"{folder}/memory"), f"{folder}/state")
        assert not any(p.stateOperators for p in query.recentProgress)
    got = spark.read.schema("event_id long, fresh boolean").option("recursiveFileLookup", "true").parquet(f"{folder}/out").orderBy("event_id").collect()
    assert [r["fresh"] for r in got] == readers.bounded_first_seen(titles)
