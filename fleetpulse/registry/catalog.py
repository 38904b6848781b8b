"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def load_all() -> None:
    from fleetpulse.registry import queries_data, queries_features, queries_metrics, queries_models, queries_patterns, queries_sampling, queries_text  # noqa: F401
