"""Checks of published tables against each other.  All give rows (artifact, rule, detail); none means all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import EMAIL


def unknown(rows: DataFrame, ref: str, known: DataFrame, id_: str = "id") -> DataFrame:
    """Rows whose reference isn't among the known ids."""
    return rows.join(known.select(F.col(id_).alias(ref)).distinct(), ref, "left_anti")


def violation(rows: DataFrame, artifact: str, rule: str, detail: str) -> DataFrame:
    return rows.select(F.lit(artifact).alias("artifact"), F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail"))


def unique_ids(rows: DataFrame, artifact: str, id_: str = "id") -> DataFrame:
    """Ids that are missing or stand more than once."""
    repeated = rows.groupBy(id_).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_).isNull() | (F.col(id_).cast("string") == ""))
    return violation(repeated, artifact, "unique id", id_)


def known_ids(rows: DataFrame, artifact: str, ref: str, known: DataFrame, id_: str = "id") -> DataFrame:
    return violation(unknown(rows.where(F.col(ref).isNotNull()), ref, known, id_), artifact, f"known {ref}", ref)


def finite(rows: DataFrame, artifact: str, column: str, id_: str = "id") -> DataFrame:
    bad = F.col(column).isNull() | F.isnan(column) | (F.abs(F.col(column)) == float("inf"))
    return violation(rows.where(bad), artifact, f"finite {column}", id_)


def same_length(rows: DataFrame, artifact: str, column: str, id_: str = "id") -> DataFrame:
    """Rows whose array isn't as long as the first length there is."""
    least = rows.agg(F.min(F.size(column)).alias("least"))
    return violation(rows.join(F.broadcast(least)).where((F.size(column) != F.col("least")) | (F.size(column) <= 0)), artifact, f"length of {column}", id_)


def no_email(rows: DataFrame, artifact: str, id_: str = "id") -> DataFrame:
    """Rows that hold an address in any column, and any column that is named for one."""
    named = [c for c in rows.columns if c.lower() in ("email", "authoremails", "author_emails")]
    whole = F.to_json(F.struct(*rows.columns))
    hit = whole.rlike(EMAIL) if not named else F.lit(True)
    return violation(rows.where(hit), artifact, "no email", id_)


def level_sizes(assigned: DataFrame, records: DataFrame, artifact: str = "clusters") -> DataFrame:
    """Levels (k) that don't assign each record exactly once."""
    n = records.agg(F.count(F.lit(1)).alias("n"))
    per = assigned.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))
    return violation(per.join(F.broadcast(n)).where((F.col("rows") != F.col("n")) | (F.col("ids") != F.col("n")) | (F.col("k") < 2)), artifact, "level", "k")


def shards(spark, path: str, name: str, index: DataFrame, by: str = "type") -> DataFrame:
    """A published table of shards against the index (id, and the shard's column): ids, shards without rows, and its pin."""
    from loomery.operators import artifacts

    rows = artifacts.read(spark, path, name, check=False)
    parts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    checks = [
        violation(unknown(rows, "id", index), "shards", "known id", "id"),
        violation(unknown(index.select("id"), "id", rows), "shards", "id in no shard", "id"),
        violation(unknown(index.select(by).distinct(), by, parts, by), "shards", "empty shard", by),
    ]
    if name in artifacts.broken(spark, path):
        checks.append(spark.createDataFrame([("shards", "pin", name)], "artifact string, rule string, detail string"))
    return all_of(*checks)


def all_of(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
