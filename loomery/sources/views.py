"""Views of the driver's tables in the shapes that the operators take, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions.text import normalize_whitespace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records.  Everything but the text follows from doc_id, lang and source."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kind = F.when(i % 10 == 0, "poster").when(i % 10 == 1, "workshop").otherwise("paper")
    title = F.array_join(F.slice(F.split(normalize_whitespace(F.col("text")), " "), 1, 12), " ")
    status = F.when(i % 4 == 0, "downloaded").when(i % 4 == 1, "blocked").when(i % 4 == 2, "unavailable").otherwise("metadata")
    return d.select(
        F.concat(F.lit("doc-"), i.cast("string")).alias("id"), i.alias("ord"), kind.alias("type"), title.alias("title"), F.col("text").alias("abstract"),
        F.col("source").alias("category"), F.array("source").alias("category_tags"), F.array("lang").alias("area_tags"), F.expr("cast(array() as array<string>)").alias("domain_tags"),
        F.concat_ws("; ", F.concat(F.lit("Anna "), F.col("source")), F.concat(F.lit("Bo "), F.col("lang")), F.when(i % 3 == 0, F.concat(F.lit("Émile "), (i % 7).cast("string")))).alias("authors"),
        F.when(kind == "workshop", "Workshop").otherwise("Main Conference").alias("group"),
        F.when(i % 6 == 0, "Oral").when(i % 6 == 1, "Spotlight").when(i % 6 == 2, "Poster").otherwise("").alias("presentation_type"),
        F.when(i % 5 == 0, F.concat(F.lit("Session "), (i % 8).cast("string"))).otherwise("").alias("session"),
        F.when(i % 7 == 0, "Hall A").otherwise("").alias("room"), status.alias("availability_status"),
        (i % 3 == 0).alias("has_pdf"), (i % 5 == 0).alias("has_poster"), (i % 7 == 0).alias("has_slide"),
        F.concat(F.lit("https://openreview.net/forum?id=r"), i.cast("string")).alias("page_url"), F.lit("").alias("doi"),
    )


CORPUS = r"""
corpus AS (SELECT 'doc-' || doc_id AS id, doc_id AS ord,
  CASE WHEN doc_id % 10 = 0 THEN 'poster' WHEN doc_id % 10 = 1 THEN 'workshop' ELSE 'paper' END AS type,
  array_to_string((string_split(trim(regexp_replace(coalesce(text, ''), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')), ' '))[1:12], ' ') AS title,
  text AS abstract, source AS category, [source] AS category_tags, [lang] AS area_tags, []::VARCHAR[] AS domain_tags,
  concat_ws('; ', 'Anna ' || source, 'Bo ' || lang, CASE WHEN doc_id % 3 = 0 THEN 'Émile ' || (doc_id % 7) END) AS authors,
  CASE WHEN doc_id % 10 = 1 THEN 'Workshop' ELSE 'Main Conference' END AS "group",
  CASE doc_id % 6 WHEN 0 THEN 'Oral' WHEN 1 THEN 'Spotlight' WHEN 2 THEN 'Poster' ELSE '' END AS presentation_type,
  CASE WHEN doc_id % 5 = 0 THEN 'Session ' || (doc_id % 8) ELSE '' END AS session,
  CASE WHEN doc_id % 7 = 0 THEN 'Hall A' ELSE '' END AS room,
  CASE doc_id % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'blocked' WHEN 2 THEN 'unavailable' ELSE 'metadata' END AS availability_status,
  doc_id % 3 = 0 AS has_pdf, doc_id % 5 = 0 AS has_poster, doc_id % 7 = 0 AS has_slide,
  'https://openreview.net/forum?id=r' || doc_id AS page_url, '' AS doi
  FROM documents)"""

WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, parts as what they cite: record_id, ord, pos, key."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("key"))


BIBLIOGRAPHY = "bibliography AS (SELECT l_orderkey AS record_id, l_linenumber AS pos, 'part ' || l_partkey AS key FROM lineitem)"


def cited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("area"))


CITED = "cited AS (SELECT o_orderkey AS record_id, o_orderpriority AS category, o_orderstatus AS area FROM orders)"


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the orders as works, their suppliers as authors: work_id, pos, author, name, topic.

    Names repeat: forty names stand for all suppliers, so identities have to be told by coauthors.
    """
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    own = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    k = F.col("l_suppkey")
    return own.select(F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("s"), k.cast("string")).alias("author"), F.concat(F.lit("Name "), (k % 40).cast("string")).alias("name"), F.col("o_orderpriority").alias("topic"))


AUTHORSHIP = "authorship AS (SELECT l_orderkey AS work_id, l_linenumber AS pos, 's' || l_suppkey AS author, 'Name ' || (l_suppkey % 40) AS name, o_orderpriority AS topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("int").alias("cluster"))


DENSE = "dense AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label::INTEGER AS cluster FROM embeddings)"


def with_views(*views: str) -> str:
    return "WITH " + ", ".join(views)
