"""All registered queries."""

from __future__ import annotations

import importlib

from loomery.plans.registry import QUERIES, Query, Run

MODULES = ("scalar_queries", "corpus_queries", "graph_queries", "semantic_queries", "artifact_queries")


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"loomery.plans.{name}")
    return QUERIES


def runs() -> dict[str, Run]:
    return {n: q.run for n, q in all_queries().items()}


def oracles() -> dict[str, str]:
    return {n: q.sql for n, q in all_queries().items() if q.sql}
