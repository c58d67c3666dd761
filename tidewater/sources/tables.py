"""Keyed tables of parquet files that micro-batches and several writers can merge into, each batch once.

A table is a folder of data and a log.  An entry of the log is a small JSON file named by its version: the schema, which
folder holds each day, and the last batch of every stream that is in.  A merge reads the days that its rows touch, writes
them anew under a folder of its own, and renames its entry to the next version, which fails where another writer was first;
then it starts over from that writer's version.  Readers take the last entry and see all of a merge or nothing of it.

Of rows with one key the last merged stays; of those within a merge that with the greatest `latest`, then as JSON.  A null
in a key is a value like others; rows without a time are of the day `none`.  A batch that is in already, by its stream's id
and its number, changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.schemas import KEYS, TABLES

NO_DAY = "none"


class Store:
    """The few steps on files that a log takes, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(folder))) if self.fs.exists(self.at(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, text: str, name: str) -> bool:
        """Writes a file in one step; False if there is one of that name."""
        draft = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(draft), False)
        stream.write(text.encode())
        stream.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.at(draft), self.at(name), options)
        except Exception as error:
            self.fs.delete(self.at(draft), False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass(frozen=True)
class Version:
    """What a log entry says."""

    number: int = -1
    schema: str = ""
    folders: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    """A table whose rows are told apart by `key` and kept by the day of `time`; the schema is that of what is merged first, unless given, and grows with new columns."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], time: str | None = None, schema: str | None = None) -> None:
        self.spark, self.path, self.key, self.time = spark, path, key, time
        self.store = Store(spark, path)
        if schema and self.version().number < 0:
            empty = spark.createDataFrame([], schema).schema.json()
            self.store.publish(json.dumps(asdict(Version(0, empty))), self._entry(0))

    @staticmethod
    def _entry(number: int) -> str:
        return f"log/{number:012d}.json"

    def version(self) -> Version:
        """The last version; its number is -1 where nothing was written yet."""
        names = [n for n in self.store.names("log") if n[0] != "."]
        return Version(**json.loads(self.store.read(f"log/{names[-1]}"))) if names else Version()

    def read(self, *days: str) -> DataFrame:
        """The rows of some days (yyyy-mm-dd), or of all, with their `day`."""
        return self._read(self.version(), days or None)

    def _read(self, version: Version, days) -> DataFrame:
        schema = StructType.fromJson(json.loads(version.schema)) if version.schema else StructType()
        schema = StructType([*schema.fields]).add("day", "string")
        folders = [f for d, f in version.folders.items() if days is None or d in days]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/{f}" for f in folders))
        return rows.select(*schema.names)

    def merge(self, rows: DataFrame, batch: tuple[str, int] | None = None, latest: str | None = None) -> Version:
        """Puts the rows in place of those with their keys.  batch: the stream's id and the number of the micro-batch."""
        names = rows.columns
        last = F.struct(*([F.col(latest)] if latest else []), F.to_json(F.struct(*names)))
        day = F.coalesce(F.date_format(F.to_date(self.time), "yyyy-MM-dd"), F.lit(NO_DAY)) if self.time else F.lit(NO_DAY)
        new = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in self.key)).agg(F.max_by(F.struct(*names), last).alias("row")).select("row.*").withColumn("day", day)
        while True:
            now = self.version()
            if batch and now.applied.get(batch[0], -1) >= batch[1]:
                return now
            folder = f"data/commit={uuid.uuid4().hex}"
            # What came in is written first: its days are then known and it is computed once.
            staged = f"{self.path}/staged/{uuid.uuid4().hex}"
            new.write.parquet(staged)
            fresh = self.spark.read.schema(new.schema).parquet(staged)
            if now.schema:  # files of other days keep their types
                known = StructType.fromJson(json.loads(now.schema))
                fresh = fresh.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in known.fields if f.name in names})
            days = [r["day"] for r in fresh.select("day").distinct().collect()]
            old = self._read(now, days)
            merged = fresh
            if any(d in now.folders for d in days):
                same = reduce(lambda a, b: a & b, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in ["day", *self.key]))
                kept = old.alias("old").join(fresh.select("day", *self.key).alias("new"), same, "left_anti")
                merged = kept.unionByName(fresh, allowMissingColumns=True)
            elif now.schema:
                merged = old.unionByName(fresh, allowMissingColumns=True)
            merged.write.partitionBy("day").parquet(f"{self.path}/{folder}")
            kind = StructType([f for f in merged.schema.fields if f.name != "day"])
            then = Version(now.number + 1, kind.json(), {**now.folders, **{d: f"{folder}/day={d}" for d in days}}, {**now.applied, **({batch[0]: batch[1]} if batch else {})})
            done = self.store.publish(json.dumps(asdict(then)), self._entry(then.number))
            self.store.drop(staged.removeprefix(f"{self.path}/"))
            if done:
                return then
            self.store.drop(folder)

    def tidy(self, keep: int = 2) -> None:
        """Drops what the last `keep` versions don't need; no merge or reader of older ones may be under way."""
        names = [n for n in self.store.names("log") if n[0] != "."]
        needed = {f.split("/")[1] for n in names[-keep:] for f in json.loads(self.store.read(f"log/{n}"))["folders"].values()}
        for commit in set(self.store.names("data")) - needed:
            self.store.drop(f"data/{commit}")
        for n in names[:-keep]:
            self.store.drop(f"log/{n}")


def open_tables(spark: SparkSession, folder: str) -> dict[str, KeyedTable]:
    """The engine's tables, made empty where there are none."""
    return {name: KeyedTable(spark, f"{folder}/{name}", KEYS[name], time, schema) for name, (schema, time) in TABLES.items()}


def stream_id(batch: DataFrame) -> str:
    """The id of the stream whose micro-batch this is: it stays over restarts from one checkpoint, and no other stream has it."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def scored_batch(tables: dict[str, KeyedTable], stream: str | None = None):
    """For foreachBatch: feature vectors always, alerts for anomalies, drift where there is any, each table once for a batch.

    A run that ends between two tables is made up for when the batch comes again: what is in stays, what isn't is merged.
    `stream` names the stream where the batches aren't those of a streaming query.
    """

    def write(batch: DataFrame, number: int) -> None:
        of = (stream or stream_id(batch), number)
        if not of[0]:
            raise ValueError("the batch is of no streaming query: name the stream")
        at = F.timestamp_millis("window_end")
        rows = batch.withColumn("window_end", at).persist()
        try:
            vectors = rows.drop("drifted", "severities", "events")
            tables["feature_vectors"].merge(vectors, of)
            found = rows.where("is_anomaly").withColumn("detected_at", F.col("window_end"))
            tables["anomaly_alerts"].merge(found.select(*(c for c in ("detected_at", "ticker", "anomaly_score", "reason", "detector_scores") if c in found.columns)), of)
            if "drifted" in rows.columns:
                drifts = rows.where(F.size("drifted") > 0).select(F.col("window_end").alias("detected_at"), "ticker", F.explode("drifted").alias("feature_name"), F.lit("adwin").alias("drift_type"))
                tables["drift_events"].merge(drifts, of)
        finally:
            rows.unpersist()

    return write
