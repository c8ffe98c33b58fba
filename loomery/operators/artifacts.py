"""Published tables: written one by one, their manifest last, each pinned by a fingerprint of its content.

A manifest that isn't there means nothing was published; a table that doesn't match its pin isn't read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.ranking import content_fingerprint

MANIFEST = "_manifest"


class BrokenPin(ValueError):
    """A table whose content isn't what its manifest says."""


def fingerprint(df: DataFrame) -> str:
    return content_fingerprint(df).first()["fingerprint"]


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def publish(tables: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None) -> dict:
    """Writes the tables, empty ones too, then the manifest: schema, rows and pin of each."""
    spark = next(iter(tables.values())).sparkSession
    entries = {}
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        by = (partition_by or {}).get(name)
        (writer.partitionBy(by) if by else writer).parquet(f"{path}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{name}").select(df.columns)
        entries[name] = {"rows": back.count(), "columns": df.columns, "schema": df.schema.json(), "pin": fingerprint(back)}
    row = [(json.dumps({"tables": entries}, sort_keys=True),)]
    spark.createDataFrame(row, "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/{MANIFEST}")
    return entries


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()["value"])["tables"]


def read(spark: SparkSession, path: str, name: str, check: bool = True) -> DataFrame:
    """A published table; its pin is compared first unless check is off."""
    from pyspark.sql.types import StructType

    entry = manifest(spark, path)[name]
    df = spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{path}/{name}").select(entry["columns"])
    if check and fingerprint(df) != entry["pin"]:
        raise BrokenPin(f"{path}/{name}")
    return df


def broken(spark: SparkSession, path: str) -> list[str]:
    """Tables whose content isn't what the manifest pins, or that are gone."""
    out = []
    for name in manifest(spark, path):
        try:
            read(spark, path, name)
        except Exception:  # noqa: BLE001  gone or unreadable is broken too
            out.append(name)
    return out


def warm(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made before from inputs of the same fingerprint, else made now and kept under it."""
    at = f"{path}/stages/{key.replace(':', '-')}"
    if not exists(spark, f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose bytes haven't been extracted before."""
    return files.join(known.select("sha256").distinct(), "sha256", "left_anti")


def export_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines, for readers that want them."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
