"""Warehouse schema exports: INFORMATION_SCHEMA-like JSON, and a live catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.identity import canonical_type, column_id, make_id
from skeinwork.schemas import Graph, graph_of

EXPORT = "warehouse string, tables array<struct<database:string,schema:string,name:string,columns:array<struct<name:string,data_type:string,nullable:boolean,ordinal_position:int,comment:string>>>>"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(warehouse, database, schema, table, columns): a row per table of an export."""
    raw = spark.read.schema(EXPORT).option("multiLine", True).json(str(path))
    return raw.select("warehouse", F.explode("tables").alias("t")).select("warehouse", "t.database", "t.schema", F.col("t.name").alias("table"), "t.columns")


def read_catalog(spark: SparkSession, database: str = "default") -> DataFrame:
    """The same rows from the session's catalog."""
    rows = []
    for t in spark.catalog.listTables(database):
        columns = [(c.name, c.dataType, c.nullable, i + 1, c.description) for i, c in enumerate(spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}"))]
        rows.append(("spark", t.catalog, database, t.name, columns))
    return spark.createDataFrame(rows, "warehouse string, database string, schema string, table string, columns array<struct<name:string,data_type:string,nullable:boolean,ordinal_position:int,comment:string>>")


def full_name() -> F.Column:
    return F.concat_ws(".", "database", "schema", "table")


def warehouse_graph(tables: DataFrame) -> Graph:
    """A table node and its column nodes for every row of ``tables``, with bindings and complete derivation; no edges."""
    binding = lambda column: F.array(F.struct("warehouse", "database", "schema", "table", column.alias("column")))
    derivation = F.struct(F.lit("complete").alias("status"), F.lit("high").alias("confidence"), F.lit("information_schema").alias("source"), F.array().cast("array<string>").alias("errors"))
    name = full_name()
    t = tables.select(
        make_id("table", name).alias("id"), F.lit("table").alias("kind"), F.col("table").alias("name"), name.alias("qualified_name"), "schema", derivation.alias("derivation"), binding(F.lit(None).cast("string")).alias("bindings"),
        F.create_map(F.lit("warehouse_metadata"), F.to_json(F.struct("warehouse", F.size("columns").alias("column_count")))).alias("aspects"),
    )
    each = tables.select("*", F.explode("columns").alias("c"))
    c = each.select(
        column_id(name, F.col("c.name")).alias("id"), F.lit("column").alias("kind"), F.col("c.name").alias("name"), F.concat(name, F.lit("."), "c.name").alias("qualified_name"), "schema", derivation.alias("derivation"), binding(F.col("c.name")).alias("bindings"),
        F.create_map(F.lit("warehouse_metadata"), F.to_json(F.struct("warehouse", "c.data_type", "c.nullable", "c.ordinal_position", "c.comment"))).alias("aspects"),
    )
    return graph_of(tables.sparkSession, t.unionByName(c))


def column_types(tables: DataFrame, dialect: str = "") -> tuple[DataFrame, DataFrame]:
    """(dataset, column, type) with canonical types, and a warning for every type that has none."""
    each = tables.select(F.lower(full_name()).alias("dataset"), F.explode("columns").alias("c"))
    typed = each.select("dataset", F.lower("c.name").alias("column"), F.col("c.data_type").alias("raw"), canonical_type(F.col("c.data_type"), dialect).alias("type"))
    lost = typed.filter("type is null and trim(coalesce(raw, '')) <> ''")
    id_ = F.concat(F.lit("column:"), "dataset", F.lit("."), "column")
    warnings = lost.select(F.lit("unsupported_column_type").alias("code"), F.concat(id_, F.lit(" has the unsupported type "), "raw").alias("message"), F.lit(None).cast("string").alias("location"), id_.alias("subject_id"))
    return typed.filter("type is not null").select("dataset", "column", "type"), warnings


def resolve_types(warehouse: DataFrame, catalog: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, column, type, source): the warehouse's type, else the catalog's, else the manifest's; and a ``type_conflict`` for every other that differs."""
    tagged = [df.select("dataset", "column", "type", F.lit(rank).alias("rank"), F.lit(name).alias("source")) for rank, (name, df) in enumerate((("warehouse", warehouse), ("catalog", catalog), ("manifest", manifest)))]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    best = every.groupBy("dataset", "column").agg(F.min_by(F.struct("type", "source"), "rank").alias("best"), F.collect_set(F.struct("source", "type")).alias("all"))
    lost = best.select("dataset", "column", "best", F.explode("all").alias("o")).filter("o.type <> best.type")
    id_ = F.concat(F.lit("column:"), "dataset", F.lit("."), "column")
    message = F.concat(id_, F.lit(": "), "best.source", F.lit(" says "), "best.type", F.lit(", "), "o.source", F.lit(" says "), "o.type")
    warnings = lost.select(F.lit("type_conflict").alias("code"), message.alias("message"), F.lit(None).cast("string").alias("location"), id_.alias("subject_id"))
    return best.select("dataset", "column", "best.type", "best.source"), warnings
