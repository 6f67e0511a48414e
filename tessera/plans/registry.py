"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the operator is expressible in SQL, an independent DuckDB query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from tessera.plans import (  # noqa: F401
        q_batching, q_extra, q_features, q_metrics, q_pairing, q_shaping, q_sources, q_streaming, q_text, q_vocab,
    )
