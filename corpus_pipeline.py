"""From raw documents to token ids: language, near duplicates, benchmark passages, secrets, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next stage's docs.  All but the last return the columns of documents.

Defined results: null, empty and letterless texts go with the first stage, as do those in none of the learned languages;
rows without an id are no one's duplicates and stay; of rows that share an id, and of near duplicates (ties: equal texts), the
one of the smallest id stays, one row an id; other columns of documents, whatever their names, stay with their rows up to the
last stage; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import bpe, common, decontaminate, langid, minhash, secrets
from loomery.session import shared_folder

#: A document whose best language scores below this is rejected, as is one without letters or in none of the languages.
LEAST_LANGUAGE_SCORE = 0.2
#: Workers are kept between stages, and what the last one held counts against the next run's first: so it holds little.
CACHE_ENTRIES = 20_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: learned from the rows of docs that state theirs."""
    told = langid.identify(docs)
    kept = told.where((F.col("_loom_lang.lang_pred") != "und") & F.col("_loom_lang.known") & (F.col("_loom_lang.score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates."""
    return minhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the words of benchmark windows are cut from the rest."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes [secret]; no document goes."""
    found = docs.withColumn("_loom_scan", secrets.scan_column(spark, F.col("text")))
    text = F.coalesce(F.col("_loom_scan.redacted"), F.col("text"))
    size = {"n_chars": F.when(F.col("_loom_scan.redacted").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return found.withColumns({"text": text} | size).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded."""
    return bpe.token_digests(docs, cache_entries=CACHE_ENTRIES)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: Kernels, sampled shingles and token merges have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over sf_dir's documents."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run_folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{run_folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
