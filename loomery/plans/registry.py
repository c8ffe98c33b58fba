"""Queries by name: a function of (spark, sf_dir), and SQL for the same rows where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomery.session import ship

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a function as the query of that name."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")

        @functools.wraps(run)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(ship(spark), sf_dir)

        QUERIES[name] = Query(name, shipped, sql)
        return run

    return add
