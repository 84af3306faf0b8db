"""Structural, hygiene and contract checks as relations of findings, and their severity by posture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.identity import binding_key
from skeinwork.schemas import FINDINGS, MOST_MESSAGES, POSTURES, Graph, GraphError, fill

METRIC = "struct<formula:string,unit:string,description:string,depends_on:array<string>>"
QUERY = "struct<sql:string,description:string,depends_on:array<string>,compiled_sql:string>"


def _findings(df: DataFrame, check: str, tier: str, message: Column, node: Column | None = None, hint: str | None = None) -> DataFrame:
    node = node if node is not None else F.lit(None)
    return fill(df.select(F.lit(check).alias("check_id"), node.alias("node_id"), message.alias("message"), F.lit(hint).alias("fix_hint"), F.lit(tier).alias("tier")), FINDINGS)


def _q(c: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(c, F.lit("")), F.lit("'"))


def unique_node_ids(g: Graph) -> DataFrame:
    """A finding for each row of an id beyond the first."""
    extra = g.nodes.groupBy("id").agg((F.count(F.lit(1)) - 1).cast("int").alias("extra")).filter("extra > 0")
    extra = extra.select("id", F.explode(F.sequence(F.lit(1), "extra")))
    return _findings(extra, "check.unique_node_ids", "structural", F.concat(_q(F.col("id")), F.lit(" names more than one node")), F.col("id"), "Give every node an id of its own")


def edges_resolve(g: Graph) -> DataFrame:
    """A finding for each end of an edge without a node."""
    ends = g.edges.select("kind", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source_id").alias("id")), F.struct(F.lit("target").alias("end"), F.col("target_id").alias("id")))).alias("e")).select("kind", "e.end", "e.id")
    lost = ends.join(g.nodes.select("id").distinct(), "id", "left_anti")
    message = F.concat(F.lit("No node "), _q(F.col("id")), F.lit(" for the "), "end", F.lit(" of an edge of kind "), "kind")
    return _findings(lost, "check.edges_resolve", "structural", message, F.col("id"), "Add the node or drop the edge")


def duplicate_bindings(g: Graph) -> DataFrame:
    """A finding for each node that shares a physical binding with an earlier one, in order of ids."""
    each = g.nodes.filter("bindings is not null").select("id", F.explode("bindings").alias("b")).select("id", binding_key(F.col("b")).alias("key")).distinct()
    each = each.filter(F.concat(*[F.col(f"key.{f}") for f in ("warehouse", "database", "schema", "table", "column")]) != "")
    first = each.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = each.join(first, "key").filter("id <> first")
    key = F.concat(F.lit("("), F.concat_ws(", ", *[_q(F.col(f"key.{f}")) for f in ("warehouse", "database", "schema", "table", "column")]), F.lit(")"))
    message = F.concat(_q(F.col("id")), F.lit(" is bound to "), key, F.lit(", as "), _q(F.col("first")), F.lit(" is"))
    return _findings(shared, "check.duplicate_bindings", "structural", message, F.col("id"), "Bind one node only to this place")


def derivation_status(g: Graph) -> DataFrame:
    status = F.col("derivation.status")
    message = F.concat(F.lit("Derivation of "), "id", F.lit(": "), status, F.lit(", confidence "), F.coalesce(F.col("derivation.confidence"), F.lit("unknown")))
    hint = "See why its lineage stays open"
    partial = _findings(g.nodes.filter(status == "partial"), "check.partial_derivation", "warn", message, F.col("id"), hint)
    return partial.unionByName(_findings(g.nodes.filter(status == "failed"), "check.failed_derivation", "error", message, F.col("id"), hint))


def zero_column_lineage(g: Graph) -> DataFrame:
    n = g.edges.agg(F.count_if(F.col("kind") == "derives_from").alias("n")).filter("n = 0")
    return _findings(n, "check.zero_column_lineage", "warn", F.lit("The graph has no derives_from edge, so impact stops at tables"), None, "Give compiled SQL and the columns of source tables")


def duplicate_formulas(g: Graph) -> DataFrame:
    """A finding for each metric whose formula, trimmed and lower-cased, an earlier metric has."""
    formula = F.lower(F.trim(F.from_json(F.col("aspects")["metric"], METRIC)["formula"]))
    metrics = g.nodes.filter("kind = 'metric'").select("id", formula.alias("formula")).filter("formula <> ''")
    first = metrics.groupBy("formula").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = metrics.join(first, "formula").filter("id <> first")
    return _findings(shared, "check.duplicate_formula", "warn", F.concat(_q(F.col("id")), F.lit(" has the formula of "), _q(F.col("first"))), F.col("id"))


CHECKS = (unique_node_ids, edges_resolve, duplicate_bindings, derivation_status, zero_column_lineage, duplicate_formulas)


def severity(tier: Column, posture: str) -> Column:
    """structural is always an error; strict keeps tiers, standard makes them warnings, permissive drops them."""
    if posture not in POSTURES:
        raise GraphError(f"unknown posture: {posture!r}")
    rest = {"strict": F.when(tier.isin("error", "warn"), tier), "standard": F.when(tier.isin("error", "warn"), F.lit("warn")), "permissive": F.lit(None).cast("string")}
    return F.when(tier == "structural", F.lit("error")).otherwise(rest[posture])


def warnings_as_findings(g: Graph) -> DataFrame:
    return fill(g.warnings.select(F.concat(F.lit("check."), "code").alias("check_id"), F.col("subject_id").alias("node_id"), "message", F.lit("warn").alias("tier")), FINDINGS)


def run_checks(g: Graph, posture: str = "standard", more: tuple = ()) -> DataFrame:
    """All findings with a severity under the posture; ``more`` are further checks, functions of the graph."""
    found = reduce(DataFrame.unionByName, [*[check(g) for check in (*CHECKS, *more)], warnings_as_findings(g)])
    return found.withColumn("severity", severity(F.col("tier"), posture)).filter("severity is not null")


def enforce_checks(g: Graph, posture: str = "standard") -> DataFrame:
    """The findings; raises with all errors' messages if there are any."""
    report = run_checks(g, posture)
    raise_all(report.filter("severity = 'error'").select(F.concat("check_id", F.lit(": "), "message").alias("message")))
    return report


def raise_all(messages: DataFrame) -> None:
    """Raise with the messages in order and, if there are more than MOST_MESSAGES, how many are left; nothing happens if there are none."""
    first = [r.message for r in messages.orderBy("message").limit(MOST_MESSAGES + 1).collect()]
    if len(first) > MOST_MESSAGES:
        first[MOST_MESSAGES:] = [f"and {messages.count() - MOST_MESSAGES} more"]
    if first:
        raise GraphError("; ".join(first))


def contract_problems(g: Graph) -> DataFrame:
    """(id, problem) of metric and query nodes: a missing or invalid aspect, an empty formula or SQL, missing dependencies."""
    metric = F.from_json(F.col("aspects")["metric"], METRIC)
    query = F.from_json(F.col("aspects")["query"], QUERY)
    is_metric = F.col("kind") == "metric"
    nodes = g.nodes.filter(F.col("kind").isin("metric", "query"))
    raw = F.when(is_metric, F.col("aspects")["metric"]).otherwise(F.col("aspects")["query"])
    body = F.when(is_metric, metric["formula"]).otherwise(query["sql"])
    deps = F.when(is_metric, metric["depends_on"]).otherwise(query["depends_on"])
    flat = nodes.select("id", "kind", raw.alias("raw"), body.alias("body"), deps.alias("deps"))
    problem = F.when(F.col("raw").isNull(), F.concat(F.lit("missing "), "kind", F.lit(" aspect"))).when(F.trim(F.coalesce("body", F.lit(""))) == "", F.when(F.col("kind") == "metric", "empty formula").otherwise("empty sql"))
    own = flat.withColumn("problem", problem).filter("problem is not null").select("id", "problem")
    lost = flat.select("id", F.explode("deps").alias("dep")).join(g.nodes.select(F.col("id").alias("dep")).distinct(), "dep", "left_anti")
    return own.unionByName(lost.select("id", F.concat(F.lit("missing dependency "), "dep").alias("problem")))


def link_contracts(g: Graph) -> Graph:
    """``depends_on`` edges from each dependency to its metric or query, once; raises with all missing dependencies."""
    lost = contract_problems(g).filter("problem like 'missing dependency %'")
    raise_all(lost.select(F.concat("id", F.lit(": "), "problem").alias("message")))
    deps = F.coalesce(F.from_json(F.col("aspects")["metric"], METRIC)["depends_on"], F.from_json(F.col("aspects")["query"], QUERY)["depends_on"])
    pairs = g.nodes.filter(F.col("kind").isin("metric", "query")).select(F.explode(deps).alias("source_id"), F.col("id").alias("target_id")).distinct().withColumn("kind", F.lit("depends_on"))
    new = pairs.join(g.edges, ["kind", "source_id", "target_id"], "left_anti")
    from skeinwork.schemas import EDGES

    return g.with_(edges=g.edges.unionByName(fill(new, EDGES).fillna({"confidence": "high"})))
