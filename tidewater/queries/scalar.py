"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.functions import sentiment
from tidewater.session import table
from tidewater.sources import market
from tidewater.sources.market import NEWS_SQL, TICKS_SQL

from .base import ASOF, ENRICHED_SQL, FEATURES_SQL, R2, R4, R6, SCORED_SQL, enriched, feats, flagged, query, ticks


@query("fea01_price_change_rate", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 1 = 0 THEN 0::DOUBLE ELSE {R6('(l_tax * 100 - (l_quantity - 1)) / (l_quantity - 1)')} END AS rate FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.price_change_rate(F.col("l_quantity") - 1, F.col("l_tax") * 100).alias("rate"))


@query("fea02_volume_surge_ratio", f"WITH {FEATURES_SQL} SELECT ticker, window_end, CASE WHEN tick_count - 1 = 0 THEN 0::DOUBLE ELSE {R4('total_volume / (tick_count - 1)')} END AS ratio FROM feats")
def _(s, d):
    return feats(s, d).select("ticker", "window_end", S.volume_surge_ratio("total_volume", F.col("tick_count") - 1).alias("ratio"))


@query("fea03_sentiment_shift", f"WITH {NEWS_SQL} SELECT event_id, {R4('score - 0.25::DOUBLE')} AS shift FROM news")
def _(s, d):
    return market.news(s, d).select("event_id", S.sentiment_shift("score", F.lit(0.25)).alias("shift"))


@query("fea04_rounding", f"SELECT l_orderkey, l_linenumber, {R2('l_extendedprice / 7')} AS two, {R6('l_extendedprice / 7')} AS six, {R2('l_extendedprice / 8')} AS tied FROM lineitem")
def _(s, d):
    x = F.col("l_extendedprice") / 7
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.rounded(x, 2).alias("two"), S.rounded(x, 6).alias("six"), S.rounded(F.col("l_extendedprice") / 8, 2).alias("tied"))


@query("scl01_signed_sentiment", f"WITH {NEWS_SQL} SELECT event_id, label, CASE label WHEN 'negative' THEN -(abs(score_c) / 100::DOUBLE) WHEN 'positive' THEN abs(score_c) / 100::DOUBLE ELSE 0::DOUBLE END AS signed FROM news")
def _(s, d):
    return market.news(s, d).select("event_id", S.signed_label(F.upper("label")).alias("label"), S.signed_sentiment(F.upper("label"), F.abs("score_c") / F.lit(100.0)).alias("signed"))


@query("scl02_clipping", f"WITH {TICKS_SQL} SELECT event_id, 0 - least(abs(close - 102) / 3, 8::DOUBLE) / 8 AS clipped, sqrt(greatest(close - 100, 0.5::DOUBLE)) AS root FROM ticks")
def _(s, d):
    return ticks(s, d).select("event_id", (0 - F.least(F.abs(F.col("close") - 102) / 3, F.lit(8.0)) / 8).alias("clipped"), F.sqrt(F.greatest(F.col("close") - 100, F.lit(0.5))).alias("root"))


@query(
    "scl03_reason",
    f"""WITH {ENRICHED_SQL}, x AS (SELECT *, total_volume * 2500 AS v, window_end % 7 / 10::DOUBLE AS score FROM enriched)
SELECT ticker, window_end, CASE WHEN t = '' THEN printf('anomaly score=%.4f', score) ELSE t END AS reason FROM (SELECT *, concat_ws('; ',
  CASE WHEN abs(price_change_rate) > 0.02::DOUBLE THEN printf('large price move (%.2f%%)', {R2('price_change_rate * 100')}) END,
  CASE WHEN v > 1000000 THEN format('high volume ({{:,}})', v) END,
  CASE WHEN abs(sentiment_shift) > 0.3::DOUBLE THEN printf('sentiment shift (%.2f)', {R2('sentiment_shift')}) END) AS t FROM x)""",
)
def _(s, d):
    rows = enriched(s, d).withColumn("total_volume", F.col("total_volume") * 2500).withColumn("score", F.col("window_end") % 7 / F.lit(10.0))
    return rows.select("ticker", "window_end", S.anomaly_reason("score").alias("reason"))


@query("scl04_severity", f"WITH {SCORED_SQL} SELECT ticker, window_end, CASE WHEN anomaly_score < -0.4::DOUBLE THEN 'high' ELSE 'normal' END AS severity FROM flagged")
def _(s, d):
    return flagged(s, d).select("ticker", "window_end", S.severity("anomaly_score", -0.4).alias("severity"))


@query("scl05_freshness", f"WITH {NEWS_SQL} SELECT event_id, CASE WHEN m < 10 THEN 'LIVE' WHEN m < 30 THEN 'STALE' ELSE 'DOWN' END AS status FROM (SELECT event_id, (1706659200000 - ts) / 600000::DOUBLE AS m FROM news)")
def _(s, d):
    return market.news(s, d).select("event_id", S.freshness((F.lit(ASOF) - F.col("ts")) / F.lit(600000.0)).alias("status"))


@query("scl06_age_label", f"WITH {NEWS_SQL} SELECT event_id, CASE WHEN a < 120 THEN CAST(a AS VARCHAR) || 's ago' ELSE CAST(a // 60 AS VARCHAR) || 'm ago' END AS age FROM (SELECT event_id, score_c + 100 AS a FROM news)")
def _(s, d):
    return market.news(s, d).select("event_id", S.age_label(F.col("score_c") + 100).alias("age"))


@query("scl07_to_10_times", "SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_ms(date_trunc('day', ts)) AS day, epoch_ms(date_trunc('hour', ts)) AS hour, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def _(s, d):
    ts = F.col("ts").cast("timestamp")
    ms = S.to_epoch_millis(S.from_epoch_millis(S.to_epoch_millis(ts)))
    iso = F.date_format(F.to_timestamp(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss")
    return table(s, d, "events").select("event_id", ms.alias("ms"), S.to_epoch_millis(S.day_of(ts)).alias("day"), S.to_epoch_millis(F.date_trunc("hour", ts)).alias("hour"), iso.alias("iso"))


@query("scl11_json_round_trip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS text FROM events")
def _(s, d):
    rows = table(s, d, "events").withColumn("p", F.from_json("props", "k long"))
    return rows.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("text"))


@query("scl13_nested_fallback", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS title FROM events")
def _(s, d):
    item = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("title")).alias("content")))).otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("title"))))
    outer = F.coalesce(F.get_json_object(item, "$.content"), item)
    return table(s, d, "events").select("event_id", F.get_json_object(outer, "$.title").alias("title"))


@query("scl14_15_labels", "SELECT user_id, 'point:' || array_to_string(list_sort(list(DISTINCT event_type)), '+') AS point, 'PATTERN:' || min(event_type) AS pattern FROM events GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.min("event_type").alias("first"))
    return e.select("user_id", S.point_label("kinds").alias("point"), S.pattern_event("first").alias("pattern"))


@query("scl16_preview", "SELECT doc_id, substr(text, 1, 60) AS preview FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", S.headline_preview("text").alias("preview"))


LEXICON = (("the", "erhe", "le"), ("of", "anti", "la"))


@query(
    "scl01_lexicon",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda x: x IN ('the', 'erhe', 'le'))) AS p, len(list_filter(ws, lambda x: x IN ('of', 'anti', 'la'))) AS n FROM w)
SELECT doc_id, s AS score, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT doc_id, CASE WHEN p + n = 0 THEN 0::DOUBLE ELSE (p - n) / (p + n) END AS s FROM c)""",
)
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", sentiment.lexicon_score("text", *LEXICON).alias("score"))
    return rows.withColumn("label", sentiment.lexicon_label("score"))


@query("cfg07_pluggable_sentiment", f"WITH {NEWS_SQL} SELECT event_id, label AS sentiment_label, CASE label WHEN 'negative' THEN -0.5::DOUBLE WHEN 'positive' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS sentiment_score FROM news")
def _(s, d):
    return sentiment.scored_texts(market.news(s, d).select("event_id", "label"), "label", lambda texts: [(t.upper(), 0.5) for t in texts]).drop("label")
