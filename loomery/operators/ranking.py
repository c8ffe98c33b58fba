"""Ranked reductions with pinned ties: the first in order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in an order without ties, with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def numbered(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of all, with their rank: a limit before the numbering, so one task sees n rows only."""
    few = df.orderBy(*order).limit(n)
    return few.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def counted(df: DataFrame, by: list[str], label: str, ord_: str, n: int) -> DataFrame:
    """The n most frequent labels of each group; ties go to the one seen first."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("count"), F.min(ord_).alias("_first"))
    return top(counts, by, [F.desc("count"), F.asc("_first")], n).drop("_first")


def first_works(records: DataFrame) -> DataFrame:
    """One record a work (column work_key): the first that isn't a poster, else the first; in the place of the work's first record."""
    w = Window.partitionBy("work_key")
    best = F.row_number().over(w.orderBy(F.when(F.col("type") == "poster", 1).otherwise(0), "ord"))
    return records.withColumn("_best", best).withColumn("place", F.min("ord").over(w)).where(F.col("_best") == 1).drop("_best")


def scoped(records: DataFrame) -> DataFrame:
    """Each record once for each scope that it is in: all, and main or workshop."""
    own = F.when(F.col("type").isin("paper", "poster"), "main").when(F.col("type") == "workshop", "workshop")
    return records.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), own))))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row, `fingerprint`, of all rows whatever their order: digests are added up, so nothing is gathered."""
    digest = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = df.agg(*[F.coalesce(F.sum(p), F.lit(0)).alias(f"s{i}") for i, p in enumerate(parts)], F.count(F.lit(1)).alias("n"))
    return sums.select(F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(",", *[F.col(f"s{i}").cast("string") for i in range(8)], F.col("n").cast("string")), 256)).alias("fingerprint"))


def selected(wanted: DataFrame, filtered: DataFrame, ord_: str = "ord") -> DataFrame:
    """wanted, selected: the id that is wanted if the filters leave it, else the first that they leave; null if none is left."""
    first = filtered.agg(F.min_by("id", ord_).alias("_first"))
    there = filtered.select(F.col("id").alias("_there")).distinct()
    joined = wanted.join(there, wanted["wanted"] == there["_there"], "left").join(F.broadcast(first))  # one row
    return joined.select("wanted", F.coalesce("_there", "_first").alias("selected"))
