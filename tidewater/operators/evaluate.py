"""Detections against truth: matching, rates, score statistics, latencies, drift tests."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.functions.scalars import rounded
from tidewater.operators.order import value_at
from tidewater.scratch import stored


def matches(detections: DataFrame, truth: DataFrame, tolerance: int = SETTINGS.tolerance, bucket: int = 1 << 20) -> DataFrame:
    """One-to-one matches (d, g): detections in ascending order each take the nearest free truth within the tolerance, the earlier of two equally near.

    `detections` has d, `truth` has g, both whole numbers.  A greedy match only depends on what is within a
    run of indices without a gap over the tolerance, so runs are independent groups; tolerance 0 is a join.
    """
    detections, truth = detections.select("d").distinct(), truth.select("g").distinct()
    if tolerance == 0:
        return detections.join(truth, detections["d"] == truth["g"])
    both = detections.select(F.col("d").alias("x"), F.lit(0).alias("side")).unionByName(truth.select(F.col("g").alias("x"), F.lit(1).alias("side")))
    # A gap over the tolerance starts a run.  Buckets of indices keep the ordering distributed, unless a run crosses an edge.
    # Buckets of indices keep the ordering distributed; a run is named by its first index, which buckets hand on.
    rows = both.withColumn("bucket", F.floor(F.col("x") / bucket))
    w = Window.partitionBy("bucket").orderBy("x", "side")
    rows = rows.withColumn("new", F.when(F.col("x") - F.lag("x").over(w) > tolerance, F.col("x")))
    # A row for each bucket, of which one index in `bucket` has one at most.
    edges = rows.groupBy("bucket").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.max("new").alias("begun"))
    order = Window.orderBy("bucket")
    edges = edges.withColumn("new", F.when(F.coalesce(F.col("first") - F.lag("last").over(order) > tolerance, F.lit(True)), F.col("first")))
    edges = edges.withColumn("carried", F.coalesce("new", F.max(F.greatest("begun", "new")).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.join(edges.select("bucket", "carried"), "bucket")
    rows = rows.withColumn("run", F.coalesce(F.max("new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "carried"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        free = set(pdf.loc[pdf["side"] == 1, "x"].tolist())
        out = []
        for d in sorted(pdf.loc[pdf["side"] == 0, "x"].tolist()):
            for g in (g for offset in range(tolerance + 1) for g in (d - offset, d + offset)):
                if g in free:
                    free.remove(g)
                    out.append((d, g))
                    break
        return pd.DataFrame(out, columns=["d", "g"]).astype("int64")

    return rows.groupBy("run").applyInPandas(greedy, "d long, g long")


def beside(*rows: DataFrame) -> DataFrame:
    """Single-row frames with different columns as one row."""
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))


def metrics(detections: DataFrame, truth: DataFrame, rows: int, tolerance: int = SETTINGS.tolerance) -> DataFrame:
    """One row: detections, true and false positives, misses, precision, recall, f1, fp_rate, latency_mean, latency_median."""
    found = matches(detections, truth, tolerance).withColumn("latency", F.abs(F.col("d") - F.col("g")))
    a = found.agg(F.count(F.lit(1)).alias("tp"), F.coalesce(rounded(F.avg("latency"), 2), F.lit(0.0)).alias("latency_mean"), F.coalesce(rounded(F.median("latency"), 2), F.lit(0.0)).alias("latency_median"))
    d = detections.agg(F.countDistinct("d").alias("detections"))
    g = truth.agg(F.countDistinct("g").alias("truths"))
    both = beside(a, d, g)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    fp, fn = F.col("detections") - F.col("tp"), F.col("truths") - F.col("tp")
    p, r = ratio(F.col("tp"), F.col("detections")), ratio(F.col("tp"), F.col("truths"))
    return both.select(
        "detections",
        "tp",
        fp.alias("fp"),
        fn.alias("fn"),
        rounded(p, 4).alias("precision"),
        rounded(r, 4).alias("recall"),
        rounded(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), 4).alias("f1"),
        rounded(ratio(fp, F.lit(rows) - F.col("truths")), 6).alias("fp_rate"),
        "latency_mean",
        "latency_median",
    )


def recall_by_type(truth: DataFrame, found: DataFrame) -> DataFrame:
    """anomaly_type, total, matched, recall; `found` has the matched g."""
    marked = truth.join(found.select("g", F.lit(1).alias("hit")).distinct(), "g", "left")
    return marked.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched")).withColumn("recall", rounded(F.col("matched") / F.col("total"), 4))


def by_detector(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall and f1 of each name in the map `detector_scores`, on the exact rows: `is_truth` says which are anomalies."""
    each = scored.select("is_truth", F.explode("detector_scores").alias("detector", "score"))
    hit = F.col("score") < threshold
    counts = each.groupBy("detector").agg(F.count_if(hit & F.col("is_truth")).alias("tp"), F.count_if(hit & ~F.col("is_truth")).alias("fp"), F.count_if(~hit & F.col("is_truth")).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    return counts.select("detector", "tp", "fp", "fn", rounded(p, 4).alias("precision"), rounded(r, 4).alias("recall"), rounded(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), 4).alias("f1"))


def moments(x: Column, name: str) -> list[Column]:
    return [F.avg(x).alias(f"mean_{name}"), F.stddev_pop(x).alias(f"std_{name}"), F.var_pop(x).alias(f"var_{name}")]


def separation(scored: DataFrame, score: str = "score") -> DataFrame:
    """Means and population deviations of the scores with and without truth, and Cohen's d; 0 where a part is empty."""
    truth, rest = F.when(F.col("is_truth"), F.col(score)), F.when(~F.col("is_truth"), F.col(score))
    a = scored.agg(*moments(truth, "a"), *moments(rest, "n"))
    pooled = F.sqrt((F.col("var_a") + F.col("var_n")) / 2)
    d = F.when(pooled > 0, F.abs(F.col("mean_n") - F.col("mean_a")) / pooled).otherwise(F.lit(0.0))
    return a.select(*(F.coalesce(rounded(c, 4), F.lit(0.0)).alias(c) for c in ("mean_a", "std_a", "mean_n", "std_n")), F.coalesce(rounded(d, 4), F.lit(0.0)).alias("cohens_d"))


def latency_stats(df: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """mean, median, p99 and max; p99 is the value at place min(n - 1, int(0.99 n)) of the sorted ones.

    The places are found by counting ranges of values; measured values are stored first, as they would differ in each job.
    """
    rows = stored(df.select(F.col(latency).alias("v")).where("v is not null"), "latencies")
    n = rows.count()
    places = {"low": (n - 1) // 2, "high": n // 2, "p99": min(n - 1, int(0.99 * n))}
    found = {k: F.lit(value_at(rows, "v", at)).cast("double") for k, at in places.items()}
    whole = rows.agg(F.avg("v").alias("mean"), ((found["low"] + found["high"]) / 2).alias("median"), F.max("v").alias("max"), found["p99"].alias("p99"))
    return whole.select(*(rounded(c, 4).alias(c) for c in ("mean", "median", "p99", "max")))


def first_drift(drifts: DataFrame, start: int) -> DataFrame:
    """feature, latency: rows from `start` to the first drift of each feature at or after it.  `drifts` has position and drifted."""
    each = drifts.where(F.col("position") >= start).select("position", F.explode("drifted").alias("feature"))
    return each.groupBy("feature").agg((F.min("position") - F.lit(start)).alias("latency"))
