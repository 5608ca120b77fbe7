"""Registry of named queries: each is a Spark builder ``(spark, sf_dir) -> DataFrame``
plus, where the result is SQL-expressible, the equivalent DuckDB SQL over the
same parquet tables (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder under ``name`` with its oracle SQL."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that the decorators run."""
    from kestrel.plans import (  # noqa: F401
        q_sources, q_frame, q_aggregate, q_windows, q_scalars, q_quality, q_kpi, q_graph, q_text, q_vectors, q_ml, q_models, q_charts, q_stream,
        q_reports, q_evidence, q_repair, q_depth, q_rest)
