"""Helpers that the operators share: scratch tables, row references, Arrow plumbing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where keys are compared.
NO_ID = (1 << 63) - 1
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a temporary one only where that is unset and Spark runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return f"{folder}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this application; call it when all results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_and_counted(df: DataFrame, name: str, what: Column) -> tuple[DataFrame, int]:
    """`df` saved, and for how many rows `what` holds: counted as they are written, without a job of its own."""
    seen = Observation()
    out = saved(df.observe(seen, F.count_if(what).alias("n")), name)
    return out, seen.get["n"]


def drop_saved(*tables: DataFrame) -> None:
    """Deletes the files of `saved` tables that nothing reads any more: what came of them must be saved itself."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_ref(doc_id: object, text: str) -> bytes:
    """16 bytes that stand for a row: equal rows share them, so what is counted by them must not depend on how often a row repeats."""
    h = xxhash.xxh3_128(repr(doc_id).encode())
    h.update(b"\0")
    h.update(text.encode("utf-8", "surrogatepass"))
    return h.digest()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def records(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices the batches so that each holds about `max_bytes` of `column` at most (one row at least)."""
    for batch in batches:
        start, size = 0, 0
        values = batch.column(column)
        for i, n in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
            if size and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def count_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of `column`."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def flat(lists: list[list]) -> list:
    return list(chain.from_iterable(lists))


#: Bits that tell which rows may be wanted, at most; more only say yes too often.
MAX_MARKS = 1 << 28


def marks(wanted: DataFrame, *columns: str) -> tuple:
    """(broadcast bits, their number): a bit for the hash of every row of `wanted`."""
    slots = 1 << min(MAX_MARKS.bit_length() - 1, max(16, (16 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*columns), F.lit(slots)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()
    bits = np.zeros(slots // 8, np.uint8)
    for bucket, data in zip(maps.column("bucket").to_pylist(), maps.column("bits").to_pylist(), strict=True):
        part = bits[(bucket - 1) * len(data) : bucket * len(data)]
        part[:] = np.frombuffer(data, np.uint8)[: len(part)]
    return wanted.sparkSession.sparkContext.broadcast(bits), slots


def marked(df: DataFrame, found: tuple, *columns: str, yes: bool = True) -> DataFrame:
    """The rows that may be among those that the marks were made of, or those that surely aren't: no shuffle."""
    shared, slots = found

    @F.arrow_udf("boolean")
    def hit(slot: pa.Array) -> pa.Array:
        at = slot.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1) == int(yes))

    return df.where(hit(F.pmod(F.xxhash64(*columns), F.lit(slots))))


ROW_KEY = ["__key_of_the_row", "__hash_of_the_row"]


def with_row_key(docs: DataFrame) -> DataFrame:
    """`docs` with what tells its rows apart: doc_id, a null one larger than all others, and a 128-bit hash of the text."""
    hashed = F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(F.col("text").cast("binary"))))
    return docs.withColumns({ROW_KEY[0]: F.coalesce("doc_id", F.lit(NO_ID)), ROW_KEY[1]: hashed})


def one_of_each_class(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each class the row with the least key, once.  classes: class and the row's key, a row for each of `keyed`.

    Only rows that may go, or that are repeated, are shuffled; the others are told apart by their marks where they are read.
    """
    classes = classes.select("class", *ROW_KEY)
    keep = classes.groupBy("class").agg(F.min(F.struct(*ROW_KEY)).alias("of")).select(*(F.col(f"of.{k}").alias(k) for k in ROW_KEY), F.lit(True).alias("__kept"))
    several = classes.groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("__rows")).join(keep, ROW_KEY, "left").where("__kept is null or __rows > 1")
    several = saved(several.select(*ROW_KEY, F.coalesce("__kept", F.lit(False)).alias("__kept")), "classes")
    found = marks(several, *ROW_KEY)
    unsure = marked(keyed, found, *ROW_KEY).join(several, ROW_KEY, "left").where("coalesce(__kept, true)").drop("__kept").dropDuplicates(ROW_KEY)
    return marked(keyed, found, *ROW_KEY, yes=False).unionByName(unsure).drop(*ROW_KEY)
