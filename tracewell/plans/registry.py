"""All registered queries, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans import q_analysis, q_correlation, q_graph, q_intel, q_ioc, q_normalize, q_pipeline

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [q_correlation, q_ioc, q_analysis, q_graph, q_normalize, q_intel, q_pipeline]
FLAGSHIP: Query = q_pipeline.QUERIES["investigate"]


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
