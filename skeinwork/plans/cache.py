"""Compiled graphs kept as Parquet, keyed by a digest of all their inputs and scope."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from skeinwork.plans.project import Dataset, compile_project, fingerprint, scoped
from skeinwork.schemas import EDGES, NODES, WARNINGS, Graph, graph_of

SECTIONS = {"nodes": NODES, "edges": EDGES, "warnings": WARNINGS}


def read_cached(spark: SparkSession, folder: str, key: str) -> Graph | None:
    """The graph of a key, or none if there is none or it wasn't written to its end."""
    try:
        parts = {name: spark.read.parquet(f"{folder}/{key}/{name}") for name in SECTIONS}
        spark.read.parquet(f"{folder}/{key}/done")
    except AnalysisException:
        return None
    return graph_of(spark, **parts)


def compile_cached(spark: SparkSession, datasets: list[Dataset], folder: str, targets: list[str] | None = None, dialect: str = "") -> Graph:
    """The graph of some targets and what they need (of all without targets), compiled once per state of its inputs."""
    some = scoped(datasets, targets) if targets else datasets
    key = fingerprint([*some, Dataset(f"dialect:{dialect}")])
    found = read_cached(spark, folder, key)
    if found is None:
        g = compile_project(spark, some, dialect)
        for name in SECTIONS:
            getattr(g, name).write.mode("overwrite").parquet(f"{folder}/{key}/{name}")
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/{key}/done")
        found = read_cached(spark, folder, key)
    return found
