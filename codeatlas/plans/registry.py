"""Registered queries: every operator of the inventory run over the input tables, each paired
with an equivalent SQL statement that an independent engine can run on the same tables.

Code-shaped inputs (source files, artefacts with fences, analyses, docs) do not exist in the input
tables, so each query derives them with deterministic expressions from the input tables, in the
Spark plan and identically in the SQL text.  Every query reads whole tables; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, root) -> DataFrame`` under ``name`` with its SQL twin."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def sql_of(name: str) -> str:
    """SQL twin of a query registered before, to build another one on."""
    return _SQL[name]


def T(spark: SparkSession, root: str, name: str) -> DataFrame:  # noqa: N802 - short on purpose
    return table(spark, root, name)


def _load_all() -> None:
    # Importing the modules runs their @register decorators.
    from . import (q_context, q_elements, q_graph, q_jobs, q_keys, q_media, q_retrieval,  # noqa: F401
                   q_snapshots, q_sources, q_text, q_usage)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
