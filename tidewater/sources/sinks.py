"""Sinks: tables by day, keyed messages, CSV, JSON summaries.  Tables that batches are merged into are in `tables`."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.schemas import TABLES


def init_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Empty tables where there are none; returns their paths.  Time tables are partitioned by day."""
    paths = {}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, (schema, time) in TABLES.items():
        paths[name] = f"{folder}/{name}"
        path = jvm.org.apache.hadoop.fs.Path(paths[name])
        if not path.getFileSystem(conf).exists(path):
            append(spark.createDataFrame([], schema), paths[name], time)
    return paths


def append(df: DataFrame, path: str, time: str | None = None) -> None:
    """Appends to a table; with a time column by its day, so that filters on `day` prune."""
    if time:
        df = df.withColumn("day", F.to_date(time))
        df.write.mode("append").partitionBy("day").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def messages(df: DataFrame, key: str = "ticker") -> DataFrame:
    """key and value of a topic: the row as JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def kafka_sink(stream: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Needs Spark's Kafka package on the class path."""
    return messages(stream).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(spark: SparkSession, parts: dict[str, DataFrame | dict], path: str) -> str:
    """Report frames (a few rows each) and values as one JSON text file; returns the text."""
    rows = {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    text = json.dumps(rows, default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text
