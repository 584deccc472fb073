"""Every retrieval and evaluation query, by key, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("retrieval", "wiki", "facts", "scoring", "markup", "arms", "collection", "jobs", "benchmark")


def _families():
    return [import_module(f"docloom.plans.{name}") for name in FAMILIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: query for family in _families() for key, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for family in _families() for key, sql in family.SQL.items()}
