"""All sources of a project, in a fixed order, merged and bound."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.checks import contract_problems, enforce_checks, link_contracts
from skeinwork.operators.graph import stored
from skeinwork.operators.match import attach_bindings
from skeinwork.operators.merge import merge
from skeinwork.operators.policy import enforce_floor
from skeinwork.plans.project import compile_project
from skeinwork.schemas import Graph, GraphError
from skeinwork.sources import models, warehouse
from skeinwork.sources.config import Project, alias_frame, load_intent


def ingest(spark: SparkSession, project: Project, kind: str) -> Graph:
    """The graph of one source of a project. Types of the warehouse are laid over dbt's only."""
    if kind == "warehouse":
        return warehouse.warehouse_graph(warehouse.read_export(spark, project.warehouse))
    if kind == "dbt":
        datasets = models.load(spark, str(project.dbt), project.dialect)
        if project.warehouse:
            typed, _ = warehouse.column_types(warehouse.read_export(spark, project.warehouse), project.dialect)
            names = {d.name for d in datasets if d.kind == "root"}
            types: dict[str, dict[str, str]] = {}
            for r in typed.collect():  # as many rows as the export has columns
                hit = [n for n in names if n == r.dataset or r.dataset.endswith("." + n) or n.endswith("." + r.dataset)]
                if len(hit) == 1:
                    types.setdefault(hit[0], {})[r["column"]] = r["type"]
            datasets = models.overlay(datasets, types)
        return compile_project(spark, datasets, project.dialect)
    if kind == "sql":
        graphs = [compile_project(spark, models.load_folder(spark, str(p), project.dialect), project.dialect) for p in project.sql]
        return graphs[0] if len(graphs) == 1 else merge(*graphs)
    if kind == "intent":
        return load_intent(spark, project.intent)
    raise GraphError(f"unknown source: {kind}")


def compile_graph(spark: SparkSession, project: Project, enforce: bool = True) -> Graph:
    """Ingest, merge, bind, link contracts, check and hold the security floor."""
    parts = {kind: ingest(spark, project, kind) for kind in project.kinds}
    if not parts:
        raise GraphError("a project needs a source")
    g = merge(*parts.values()) if len(parts) > 1 else next(iter(parts.values()))
    g = stored(g)
    if "warehouse" in parts and len(parts) > 1:
        g = attach_bindings(g, parts["warehouse"], alias_frame(spark, project.aliases) if project.aliases else None)
    if "intent" in parts:
        g = link_contracts(compile_contracts(spark, g, project.dialect))
    g = stored(g)
    if enforce:
        enforce_checks(g, project.posture)
        enforce_floor(g)
    return g


def compile_contracts(spark: SparkSession, g: Graph, dialect: str = "") -> Graph:
    """Check every metric and query; a query's SQL that parses becomes its ``compiled_sql``. Raises once with all problems."""
    from skeinwork.plans.parsing import parse

    problems = [f"{r.id}: {r.problem}" for r in contract_problems(g).filter("problem not like 'missing dependency %'").orderBy("id").collect()]
    good = []
    for r in g.nodes.filter("kind = 'query'").select("id", F.get_json_object(F.col("aspects")["query"], "$.sql").alias("sql")).orderBy("id").collect():
        try:
            parse(spark, r.sql or "", dialect)
            good.append((r.id, r.sql.strip().rstrip(";")))
        except GraphError as e:
            problems.append(f"{r.id}: {e}")
    if problems:
        raise GraphError("; ".join(problems))
    if not good:
        return g
    sql = spark.createDataFrame(good, "id string, compiled string")
    old = F.from_json(F.col("aspects")["query"], "map<string,string>")
    kept = F.map_filter(F.col("aspects"), lambda k, _: k != "query")
    new = F.map_concat(kept, F.create_map(F.lit("query"), F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~k.isin("compiled_sql", "depends_on")), F.create_map(F.lit("compiled_sql"), F.col("compiled"))))))
    nodes = g.nodes.join(sql, "id", "left")
    with_deps = F.when(F.col("compiled").isNotNull(), new).otherwise(F.col("aspects"))
    deps = F.get_json_object(F.col("aspects")["query"], "$.depends_on")
    text = with_deps["query"]
    joined = F.when(F.col("compiled").isNotNull() & deps.isNotNull(), F.map_concat(kept, F.create_map(F.lit("query"), F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"depends_on":'), deps, F.lit("}"))))).otherwise(with_deps)
    return g.with_(nodes=nodes.withColumn("aspects", joined).select(*g.nodes.columns))
