"""Sharding by a two-pass external shuffle.

Pass one scatters the records, uniformly and by seeded hashes, over buckets small enough for a worker's memory.  Pass
two takes each bucket into memory, shuffles it by Fisher-Yates and writes it to the shared folder.  The buckets one
after the other are then one random order of all records; dealing its places out in turn gives shards whose counts
differ by one at most (law `rows`), each in random order.

The hash takes in the record's place in the input besides its content, so a third of all rows being copies of one record
spreads like any others.  What the places are worth is fixed when pass two's result is written; everything after reads
those files.

Defined results: null texts have size 8 and crc 0; rows are kept as they are, repeated ones too; an empty table gives no
rows; other columns stay with their rows.  Column names that begin with "_loom_" are taken.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import cut, prepare, shrink_executors, store

#: Text bytes that a bucket aims at; a worker holds one bucket, a few times over.
BUCKET_BYTES = 16_000_000
SEED = 20_240_229
#: Buckets up to which their offsets are broadcast (16 MB); beyond, they are joined by a shuffle.
OFFSET_LIMIT = 1_000_000


def record_size(text_col: str = "text"):
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random order of n places, by Fisher and Yates's exchanges."""
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64) if n else order
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def scatter(docs: DataFrame, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Pass one: docs with _loom_bucket and _loom_key, dealt to one partition for each bucket."""
    total = docs.agg(F.sum(record_size(text_col))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, tasks, math.ceil(total / bucket_bytes))
    keyed = docs.withColumn("_loom_key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    return keyed.withColumn("_loom_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_loom_key"), F.lit(buckets)).cast("int")).repartition(buckets, "_loom_bucket")


def shuffle_buckets(scattered: DataFrame, seed: int = SEED) -> DataFrame:
    """Pass two: the rows of each bucket in shuffled order, _loom_place counting from 0."""
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*scattered.schema.fields]).add("_loom_place", LongType())

    def shuffled(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_loom_key", kind="stable", ignore_index=True)  # arrival differs between runs, keys don't
        order = fisher_yates(len(batch), np.random.default_rng([seed, int(batch["_loom_bucket"].iloc[0])]))
        batch = batch.iloc[order].reset_index(drop=True)
        batch["_loom_place"] = np.arange(len(batch), dtype=np.int64)
        return batch

    return scattered.groupBy("_loom_bucket").applyInPandas(shuffled, schema)


def shuffle_to_shards(docs: DataFrame, shards: int = 24, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """docs with law `rows`: columns shard (0 to shards - 1) and slot (gapless from 0) are added, both replaced if docs has them."""
    shrink_executors(prepare(docs.sparkSession))
    docs = docs.drop("shard", "slot")
    written = store(shuffle_buckets(scatter(docs, text_col, bucket_bytes, seed), seed))
    shrink_executors(docs.sparkSession)
    counts = written.groupBy("_loom_bucket").agg(F.count(F.lit(1)).alias("_loom_n"))
    before = F.coalesce(F.sum("_loom_n").over(Window.orderBy("_loom_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("_loom_bucket", before.alias("_loom_before")))  # 16 bytes for each 16 MB of text
    if offsets.count() <= OFFSET_LIMIT:
        offsets = F.broadcast(offsets)
    at = F.col("_loom_before") + F.col("_loom_place")
    placed = written.join(offsets, "_loom_bucket")
    return placed.withColumns({"shard": (at % shards).cast("int"), "slot": F.floor(at / shards).cast("long")}).drop("_loom_bucket", "_loom_key", "_loom_place", "_loom_before")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes each shard, in the order of its slots, to its own folder under path."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)

