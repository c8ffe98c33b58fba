"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.bpe import token_digests

    return token_digests(_table(spark, sf_dir, "documents"))


#: Where the cluster names the key of the pseudonyms, and what stands for it on made-up tables: it is no secret.
KEY_SETTING, TEST_KEY = "spark.loomery.pii.key", "a key for tables of made-up people"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, TEST_KEY))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents")).drop("redacted")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.sharding import record_size, shuffle_to_shards

    shards = shuffle_to_shards(_table(spark, sf_dir, "documents"), 24)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return shards.select("doc_id", record_size().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.suffix import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.minhash import classes

    return classes(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.langid import language_of_documents

    return language_of_documents(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.quality import quality_of_documents

    return quality_of_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.llm.decontaminate import verdicts

    return verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_pii, op3_secrets, op4_topk, op5_sharding, op6_repeats, op7_near_duplicates, op8_language, op9_quality, op10_decontamination)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from loomery.llm import decontaminate, topk

    return {"op4_topk": topk.ORACLE, "op10_decontamination": decontaminate.ORACLE}
