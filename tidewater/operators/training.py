"""Fitting of models and the registry of their versions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.config import FEATURES, SETTINGS

from .detectors.autoencoder import Autoencoder, LinearWeights
from .detectors.iforest import IsolationForest
from .sequence import with_iforest

#: Rows that a forest is fitted on at most: its trees use 256 each.
FOREST_ROWS = 50_000


def fit_iforest(features: DataFrame, max_rows: int = FOREST_ROWS, **kwargs) -> IsolationForest:
    """On a bounded sample by a hash of the rows, the same however they are dealt."""
    columns = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES]
    sample = features.select(*columns).orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(max_rows).toPandas()
    return IsolationForest(**kwargs).fit(sample[list(FEATURES)].to_numpy(float))


def training_summary(features: DataFrame, model: IsolationForest) -> DataFrame:
    """One row: samples, anomalies, anomaly_rate, score_mean, score_std of the rows the model was fitted for."""
    scored = with_iforest(features, model)
    return scored.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("isolation_forest") < 0).alias("anomalies"),
        F.avg((F.col("isolation_forest") < 0).cast("double")).alias("anomaly_rate"),
        F.avg("isolation_forest").alias("score_mean"),
        F.stddev_pop("isolation_forest").alias("score_std"),
    )


def normalisation(features: DataFrame) -> DataFrame:
    """Mean and population deviation of every feature."""
    return features.agg(*(f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def fit_autoencoder(features: DataFrame, order: list[str], length: int = SETTINGS.sequence_length, size: int = 8) -> Autoencoder:
    """The linear autoencoder from exact moments: every sequence counts, only a (4 x length)**2 matrix reaches the driver."""
    row = normalisation(features).first()
    mean, std = (np.array([row[f"{n}_{c}"] or 0.0 for c in FEATURES]) for n in ("mean", "std"))
    z = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(m)) / float(s + 1e-8) for c, m, s in zip(FEATURES, mean, std, strict=True)]
    w = Window.partitionBy("ticker").orderBy(*order)
    runs = features.select(F.flatten(F.collect_list(F.array(*z)).over(w.rowsBetween(1 - length, 0))).alias("v"), F.row_number().over(w).alias("rn")).where(F.col("rn") >= length)

    def sums(batches):
        import pyarrow as pa

        d = length * len(FEATURES)
        n, first, second = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([first.tolist()], pa.list_(pa.float64())), "q": pa.array([second.ravel().tolist()], pa.list_(pa.float64()))})

    parts = runs.select("v").mapInArrow(sums, "n long, s array<double>, q array<double>").collect()  # a row a task
    if not parts:
        return Autoencoder(None, mean, std, length)
    n = sum(p["n"] for p in parts)
    first, second = sum(np.array(p["s"]) for p in parts) / n, sum(np.array(p["q"]) for p in parts) / n
    _, vectors = np.linalg.eigh(second.reshape(len(first), -1) - np.outer(first, first))
    return Autoencoder(LinearWeights(first, vectors[:, ::-1][:, :size].T), mean, std, length)


def next_version(registry: DataFrame, name: str) -> int:
    """One more than the model's latest version; 1 for a new one."""
    return (registry.where(F.col("model_name") == name).agg(F.max("version").alias("v")).first()["v"] or 0) + 1


def registered(registry: DataFrame, entry: dict) -> DataFrame:
    """The registry with the entry as its model's active version and all others of that model inactive."""
    name = entry["model_name"]
    old = registry.withColumn("is_active", F.when(F.col("model_name") == name, F.lit(False)).otherwise(F.col("is_active")))
    version = next_version(registry, name)
    new = registry.sparkSession.createDataFrame([{**{c: None for c in registry.columns}, **entry, "version": version, "is_active": True}], registry.schema)
    return old.unionByName(new)


def latest(registry: DataFrame) -> DataFrame:
    """The latest version of every model."""
    rest = [c for c in registry.columns if c != "model_name"]
    return registry.groupBy("model_name").agg(F.max_by(F.struct(*rest), "version").alias("m")).select("model_name", *(f"m.{c}" for c in rest))


def save_model(spark: SparkSession, model: IsolationForest, folder: str, version: int) -> str:
    """A versioned copy and the active one, as text files in any store that Spark writes."""
    for place in (f"{folder}/v{version}", f"{folder}/active"):
        spark.createDataFrame([(json.dumps(json.loads(model.to_json())),)], "value string").coalesce(1).write.mode("overwrite").text(place)
    return f"{folder}/v{version}"


def load_model(spark: SparkSession, path: str) -> IsolationForest:
    return IsolationForest.from_json(spark.read.text(path, wholetext=True).first()["value"])
