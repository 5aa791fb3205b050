"""Registry of the core queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import flow_queries, packed_queries, report_queries, style_queries, work_queries

_MODULES = [style_queries, work_queries, flow_queries, packed_queries, report_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
