"""Registered queries of the graph engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.catalog import contracts, data_graph, static_lineage

FLAGSHIP = "graph_reach"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return data_graph.queries() | static_lineage.queries() | contracts.queries()


def oracle_sql() -> dict[str, str]:
    return data_graph.SQL | static_lineage.oracle_sql() | contracts.oracle_sql()
