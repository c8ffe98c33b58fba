"""What the operators of this package share: reading settings, cutting lineage, packing rows."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.session import shared_folder, ship

#: Rows in an Arrow batch, and in a batch of the Parquet reader: with documents of some KB, both stay at a MB or two.
BATCH_ROWS = 400
#: Bytes of a row group of stored tables: a task holds one while it writes.
ROW_GROUP = 8_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds batches by rows, and sees to it that there is a folder for checkpoints."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    shared_folder(ship(spark))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there: lost executors cost nothing done so far."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like cut(), as compressed Parquet: for tables that hold texts."""
    spark = df.sparkSession
    path = f"{shared_folder(prepare(spark))}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.parquet(path)


def give_back(*tables: dict) -> None:
    """Empties a worker's tables and hands freed memory back to the system.

    A worker process is kept for whatever stage comes next, and what it holds would count against that.  Arrow has a pool of
    its own, which the C library doesn't know.
    """
    for t in tables:
        t.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shrink_executors(spark: SparkSession) -> None:
    """Has the executors collect their garbage, which hands heap back that earlier stages needed and later ones may not."""
    n = spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collected.alias("collected")).write.format("noop").mode("overwrite").save()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer held; it does so after the driver's garbage collection.

    Events on their way to listeners hold the frames too, so these get a moment to arrive.
    """
    shrink_executors(spark)
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns that name a row by its id and content; rows equal in both get equal results."""
    return [doc_id.alias("k_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k_text")]


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written in decimal; null ids count as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def crc_of(value: object) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())
