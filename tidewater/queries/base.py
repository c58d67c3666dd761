"""The registry, and the inputs that the queries share, as plans and as SQL.

`@query(name, sql)` registers a function (spark, sf_dir) -> DataFrame; without SQL only its rows are checked.
Windows are six hours long here: the test data have about ten ticks in each then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.functions import scalars as S
from tidewater.operators import enrich, features
from tidewater.operators.cep.detector import primitive_events
from tidewater.operators.ensemble import ensemble_score
from tidewater.sources import market
from tidewater.sources.market import NEWS_SQL, TICKS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# The inputs that many queries share, as plans and as SQL.

MINUTES = market.WINDOW_HOURS * 60
SIZE = MINUTES * 60_000
#: 2024-01-31 00:00 UTC, the end of the test events: "now".
ASOF = 1_706_659_200_000
#: The data never reach three times their baseline.
CEP = replace(SETTINGS, volume_surge_ratio=1.5)
WEIGHTS = {"price": 0.40, "volume": 0.45, "lstm_ae": 0.10}


def R(x: str, digits: int) -> str:
    """What `rounded` gives: formatting rounds the exact binary value, half to even."""
    return f"(CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE) + 0::DOUBLE)"


def R2(x: str) -> str:
    return R(x, 2)


def R4(x: str) -> str:
    return R(x, 4)


def R6(x: str) -> str:
    return R(x, 6)


FEATURES_SQL = f"""{TICKS_SQL},
feats AS (SELECT ticker, window_start, window_start + {SIZE} AS window_end, {R4("sum_e4 / tick_count / 10000::DOUBLE")} AS avg_close,
  {R4("f")} AS first_close, {R4("l")} AS last_close, CASE WHEN f = 0 THEN 0::DOUBLE ELSE {R6("(l - f) / f")} END AS price_change_rate, total_volume, tick_count
  FROM (SELECT ticker, ts - ts % {SIZE} AS window_start, CAST(CAST(sum(close_e4) AS BIGINT) AS DOUBLE) AS sum_e4, arg_min(close, ts * 1000000 + event_id) AS f,
    arg_max(close, ts * 1000000 + event_id) AS l, CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS tick_count FROM ticks GROUP BY 1, 2))"""
ENRICHED_SQL = f"""{FEATURES_SQL}, {NEWS_SQL},
ranked AS (SELECT f.ticker, f.window_end, n.score_c, row_number() OVER (PARTITION BY f.ticker, f.window_end ORDER BY n.ts DESC, n.event_id DESC) AS r
  FROM feats f JOIN news n ON n.ticker = f.ticker AND n.ts <= f.window_end),
said AS (SELECT ticker, window_end, CAST(sum(score_c) FILTER (WHERE r <= 10) AS DOUBLE) / 100::DOUBLE / count(*) FILTER (WHERE r <= 10) AS new,
  CAST(sum(score_c) FILTER (WHERE r > 10) AS DOUBLE) / 100::DOUBLE / nullif(count(*) FILTER (WHERE r > 10), 0) AS old, count(*) FILTER (WHERE r <= 10) AS n FROM ranked WHERE r <= 20 GROUP BY 1, 2),
enriched AS (SELECT f.*, coalesce({R4("s.new")}, 0) AS avg_sentiment, coalesce({R4("s.new - coalesce(s.old, s.new)")}, 0) AS sentiment_shift, coalesce(s.n, 0) AS headline_count
  FROM feats f LEFT JOIN said s USING (ticker, window_end))"""
SCORED_SQL = f"""{ENRICHED_SQL},
detected AS (SELECT *, 0 - least(abs(price_change_rate) * 10::DOUBLE, 1::DOUBLE) AS price, 0 - least(total_volume / 1000::DOUBLE, 1::DOUBLE) AS volume,
  CASE WHEN tick_count < 8 THEN 0::DOUBLE ELSE 0 - least(tick_count / 20::DOUBLE, 1::DOUBLE) END AS lstm_ae FROM enriched),
scored AS (SELECT *, (0.4::DOUBLE * price + 0.45::DOUBLE * volume + (CASE WHEN lstm_ae = 0 THEN 0::DOUBLE ELSE 0.1::DOUBLE END) * lstm_ae)
  / (0.4::DOUBLE + 0.45::DOUBLE + (CASE WHEN lstm_ae = 0 THEN 0::DOUBLE ELSE 0.1::DOUBLE END)) AS anomaly_score, abs(price_change_rate) >= 0.02::DOUBLE AS is_truth FROM detected),
flagged AS (SELECT *, anomaly_score < -0.28::DOUBLE AS is_anomaly FROM scored)"""


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return market.ticks(spark, d)


def feats(spark: SparkSession, d: str) -> DataFrame:
    return features.tumbling_features(ticks(spark, d), MINUTES)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enrich(feats(spark, d), market.news(spark, d))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    """Enriched features with three plain scores, the ensemble's score and flag, and a truth to hold them against."""
    rows = enriched(spark, d).withColumns(
        {
            "price": 0 - F.least(F.abs("price_change_rate") * 10.0, F.lit(1.0)),
            "volume": 0 - F.least(F.col("total_volume") / 1000.0, F.lit(1.0)),
            "lstm_ae": F.when(F.col("tick_count") < 8, F.lit(0.0)).otherwise(0 - F.least(F.col("tick_count") / 20.0, F.lit(1.0))),
        }
    )
    scores = {n: F.col(n) for n in WEIGHTS}
    rows = rows.withColumn("anomaly_score", ensemble_score(scores, WEIGHTS)).withColumn("is_truth", F.abs("price_change_rate") >= 0.02)
    names = F.create_map(*(x for n in WEIGHTS for x in (F.lit(n), F.col(n))))
    return rows.withColumn("is_anomaly", S.is_anomaly("anomaly_score", SETTINGS.threshold)).withColumn("detector_scores", names)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enriched(spark, sf_dir)
    return rows.withColumn("events", primitive_events(F.lit(False)))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})
