"""Registry of named queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that their registrations run."""
    from churnlake.plans import (  # noqa: F401
        q_clean, q_eda, q_facts, q_features, q_io, q_kpi, q_ml, q_quality, q_rules, q_segment, q_slice, q_stream, q_xai,
    )
