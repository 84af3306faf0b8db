"""The canonical relations of a catalog graph and the values they allow."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = "array<struct<file:string,location:string,expression:string,confidence:string>>"
DERIVATION = "struct<status:string,confidence:string,source:string,errors:array<string>>"
BINDINGS = "array<struct<warehouse:string,database:string,schema:string,table:string,column:string>>"
NODES = f"id string, kind string, name string, qualified_name string, schema string, evidence {EVIDENCE}, derivation {DERIVATION}, bindings {BINDINGS}, aspects map<string,string>"
EDGES = f"kind string, source_id string, target_id string, label string, confidence string, match_status string, evidence {EVIDENCE}, derivation {DERIVATION}"
WARNINGS = "code string, message string, location string, subject_id string"
FINDINGS = "check_id string, node_id string, severity string, message string, fix_hint string, tier string"
RULES = "id string, kind string, identity string, effect string, selector_kind string"

# Fixed values of the data model.
NODE_KINDS = ("table", "cte", "column", "model", "report", "asset", "visual", "page", "measure", "metric", "query")
EDGE_KINDS = ("depends_on", "feeds", "derives_from", "references", "joins")
MATCH_STATUS = ("resolved", "ambiguous", "unresolved")
DERIVATION_STATUS = ("complete", "partial", "failed", "skipped")
CONFIDENCE = ("high", "medium", "low")
POSTURES = ("strict", "standard", "permissive")
VERSION = "1"


#: Messages that an error spells out; it also says how many more there are.
MOST_MESSAGES = 1000


class GraphError(ValueError):
    """An input or a graph breaks a rule of the model."""


@dataclass(frozen=True)
class Graph:
    """Nodes, edges and warnings; operators map graphs to graphs."""

    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame
    version: str = VERSION

    def with_(self, **changes: DataFrame) -> "Graph":
        return replace(self, **changes)

    def add_warnings(self, more: DataFrame) -> "Graph":
        return self.with_(warnings=self.warnings.unionByName(more))


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def fill(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of ``ddl``; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl)])


def graph_of(spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None, warnings: DataFrame | None = None) -> Graph:
    """A graph with canonical columns; what isn't given is empty."""
    empty = lambda ddl: spark.createDataFrame([], struct(ddl))
    edges = fill(edges, EDGES).fillna({"confidence": "high"}) if edges is not None else empty(EDGES)
    return Graph(
        fill(nodes, NODES) if nodes is not None else empty(NODES),
        edges,
        fill(warnings, WARNINGS) if warnings is not None else empty(WARNINGS),
    )
