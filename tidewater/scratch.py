"""A folder for tables between steps: in the shared folder that the session names, a temporary one where none is named and Spark runs in one process."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out within `passing`.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    path = f"{folder}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if (paths := _passing.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made inside go at its end: for micro-batches, which never stop coming."""
    token = _passing.set(paths := [])
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written and read again: computed once, and cut off from what it came from."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
