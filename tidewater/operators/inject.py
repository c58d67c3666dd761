"""Anomalies planted for evaluation, decided by a seeded hash of the row: the same rows however the data are dealt."""

from __future__ import annotations

from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.operators.order import value_at
from tidewater.scratch import stored

#: Kinds and the shares of rows that each gets, in order.
KINDS = (("price_spike", 0.33), ("volume_surge", 0.28), ("sentiment_crash", 0.22), ("multi_feature", 0.17))


def uniform(seed: int, stream: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) for each row, from its `row_id`."""
    unit = F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(stream)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.lit(low) + unit * (high - low)


def inject_points(df: DataFrame, rate: float = SETTINGS.injection_rate, seed: int = SETTINGS.seed) -> DataFrame:
    """Changes max(1, int(n * rate)) rows and names the kind in `anomaly_type` (null elsewhere).  Needs a unique `row_id`.

    Which rows: those whose hash is smallest.  The hash that ends them is found by counting; only rows that share it are sorted.
    """
    n = df.count()
    k = min(n, max(1, int(n * rate)))
    hashed = df.select("row_id", F.xxhash64("row_id", F.lit(seed), F.lit(-1)).alias("_h"))
    last = value_at(hashed, "_h", k - 1) if n else 0
    below = hashed.where(F.col("_h") < last)
    ties = hashed.where(F.col("_h") == last).orderBy("row_id").limit(k - below.count())
    chosen = below.unionByName(ties).select("row_id", F.lit(True).alias("_hit"))
    u, edge, kind = uniform(seed, 0), 0.0, F
    for name, share in KINDS[:-1]:
        edge += share
        kind = kind.when(u < edge, name)
    kind = kind.otherwise(KINDS[-1][0])
    out = df.join(chosen, "row_id", "left").withColumn("anomaly_type", F.when(F.col("_hit"), kind)).drop("_hit")
    is_ = lambda *names: F.col("anomaly_type").isin(*names)
    both = uniform(seed, 3, 3.0, 8.0)
    return out.withColumns(
        {
            "price_change_rate": F.when(is_("price_spike"), F.col("price_change_rate") * uniform(seed, 1, 5.0, 15.0)).when(is_("multi_feature"), F.col("price_change_rate") * both).otherwise(F.col("price_change_rate")),
            "total_volume": F.when(is_("volume_surge"), F.col("total_volume") * uniform(seed, 2, 5.0, 20.0)).when(is_("multi_feature"), F.col("total_volume") * uniform(seed, 4, 3.0, 8.0)).otherwise(F.col("total_volume")),
            "avg_sentiment": F.when(is_("sentiment_crash"), uniform(seed, 5, -0.9, -0.6)).otherwise(F.col("avg_sentiment")),
            "sentiment_shift": F.when(is_("sentiment_crash"), uniform(seed, 6, -0.8, -0.5)).otherwise(F.col("sentiment_shift")),
        }
    )


def drift_length(ticker: str, seed: int = SETTINGS.seed) -> int:
    """10 to 20 rows, drawn from the seed and the ticker."""
    return Random(f"{seed} {ticker}").randint(10, 20)


def inject_drift(df: DataFrame, ticker: str, order: str, length: int | None = None) -> DataFrame:
    """A block of `length` rows of a ticker (`drift_length` by default) is shifted: the first one free of other anomalies from the ticker's middle on; none if there is none."""
    length = length or drift_length(ticker)
    w = Window.partitionBy("ticker").orderBy(order)
    rows = df.withColumns({"_rn": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    ahead = w.rowsBetween(0, length - 1)
    free = (F.count("anomaly_type").over(ahead) == 0) & (F.count(F.lit(1)).over(ahead) == length) & (F.col("_rn") >= F.floor(F.col("_n") / 2)) & (F.col("ticker") == ticker)
    rows = rows.withColumn("_start", F.min(F.when(free, F.col("_rn"))).over(Window.partitionBy("ticker")))
    hit = F.coalesce((F.col("_rn") >= F.col("_start")) & (F.col("_rn") < F.col("_start") + length), F.lit(False))
    return rows.withColumns(
        {
            "price_change_rate": F.when(hit, F.col("price_change_rate") + 0.02).otherwise(F.col("price_change_rate")),
            "total_volume": F.when(hit, F.col("total_volume") * 1.5).otherwise(F.col("total_volume")),
            "avg_sentiment": F.when(hit, F.col("avg_sentiment") - 0.2).otherwise(F.col("avg_sentiment")),
            "anomaly_type": F.when(hit, "subtle_drift").otherwise(F.col("anomaly_type")),
        }
    ).drop("_rn", "_n", "_start")


def shift_last_fifth(df: DataFrame, order: list[str]) -> DataFrame:
    """The drift test's frame: from row int(0.8 n) on, price change x 3, volume x 2, sentiment - 0.3; adds `position`."""
    rows = positions(df, order)
    hit = F.col("position") >= F.floor(F.lit(0.8) * df.count())
    return rows.withColumns({"price_change_rate": F.when(hit, F.col("price_change_rate") * 3).otherwise(F.col("price_change_rate")), "total_volume": F.when(hit, F.col("total_volume") * 2).otherwise(F.col("total_volume")), "avg_sentiment": F.when(hit, F.col("avg_sentiment") - 0.3).otherwise(F.col("avg_sentiment"))})


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the row's place in a global order, ranked inside sorted partitions and offset by their sizes: no single task sorts it all.

    The ranges are stored: their bounds are sampled, and sampled anew each time they are computed.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumns({"_part": F.shiftright("_m", 33), "_local": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"), "ranges")
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")
