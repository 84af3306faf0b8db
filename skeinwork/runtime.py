"""Execution of compiled query contracts over Parquet tables, gated by policy."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.policy import gated_identity, require_allow
from skeinwork.schemas import Graph, GraphError

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register_tables(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the Parquet tables of a folder; scans stay lazy and pruned."""
    for name in tables:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def execute(spark: SparkSession, sql: str, args: dict | None = None, seed_sql: str | None = None) -> DataFrame:
    """A single query, after the statements of an optional seed script. What goes wrong is a GraphError."""
    from skeinwork.plans.parsing import statements

    try:
        for statement in statements(seed_sql or ""):
            spark.sql(statement)
        out = spark.sql(sql, args=args) if args else spark.sql(sql)
    except Exception as e:
        raise GraphError(f"the query failed: {str(e).splitlines()[0]}") from e
    if not out.columns:
        raise GraphError("the query has no result columns")
    return out


def execute_contract(spark: SparkSession, g: Graph, rules: DataFrame, identity: str | None, query_id: str, args: dict | None = None) -> DataFrame:
    """Run a query node's ``compiled_sql`` for an identity that policy allows; raw SQL is never run."""
    identity = gated_identity(identity)
    nodes = g.nodes.filter((F.col("id") == query_id) & (F.col("kind") == "query"))
    row = nodes.select(F.get_json_object(F.col("aspects")["query"], "$.compiled_sql").alias("sql")).first()
    if row is None:
        raise GraphError(f"unknown query: {query_id}")
    require_allow(nodes, rules, identity)
    if not row.sql:
        raise GraphError(f"{query_id} has no compiled SQL")
    return execute(spark, row.sql, args)


def write_bundle(documents: dict[str, str], folder: str) -> None:
    """Write documents beside each other, all or none: a staging folder is renamed when it is whole."""
    import shutil

    target, staging = Path(folder), Path(folder + ".staging")
    shutil.rmtree(staging, ignore_errors=True)
    staging.mkdir(parents=True)
    for name, text in documents.items():
        (staging / name).write_text(text)
    shutil.rmtree(target, ignore_errors=True)
    staging.rename(target)
