"""A session with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewater", **conf: str) -> SparkSession:
    """Existing settings of the cluster win over these only where they are passed in `conf`."""
    builder = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Long texts: keep what a Python worker holds at a time small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the data folder; times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
