"""Graph operators at data scale: the tables as a graph of references."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.emit.formats import openlineage_fields
from skeinwork.functions import identity
from skeinwork.operators import checks, graph, match, merge, policy
from skeinwork.plans.project import coverage, coverage_summary, stamp
from skeinwork.schemas import EDGES, Graph, fill, graph_of
from skeinwork.sources.powerbi import native_table_columns

# table -> key, name and references (kind of the target, column)
TABLES = {
    "region": ("r_regionkey", "r_name", ()),
    "nation": ("n_nationkey", "n_name", (("region", "n_regionkey"),)),
    "customer": ("c_custkey", "c_name", (("nation", "c_nationkey"),)),
    "supplier": ("s_suppkey", "s_name", (("nation", "s_nationkey"),)),
    "part": ("p_partkey", "p_name", ()),
    "orders": ("o_orderkey", "o_orderstatus", (("customer", "o_custkey"),)),
}


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _id(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def data_graph(spark: SparkSession, d: str) -> Graph:
    """A node per row and a ``references`` edge per foreign key; each order's lines give edges to parts and suppliers."""
    nodes, edges = [], []
    for table, (key, name, refs) in TABLES.items():
        t = _read(spark, d, table)
        nodes.append(t.select(_id(table, key).alias("id"), F.lit(table).alias("kind"), F.col(name).alias("name")))
        edges += [t.select(F.lit("references").alias("kind"), _id(table, key).alias("source_id"), _id(target, column).alias("target_id")) for target, column in refs]
    lines = _read(spark, d, "lineitem")
    edges += [lines.select(F.lit("feeds").alias("kind"), _id("orders", "l_orderkey").alias("source_id"), _id(t, c).alias("target_id")) for t, c in (("part", "l_partkey"), ("supplier", "l_suppkey"))]
    return graph_of(spark, reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


def graph_reach(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    seeds = g.nodes.filter("kind = 'region'").select(F.col("id").alias("node_id"))
    return graph.reach(graph.adjacency(g.edges, graph.DOWN, "references"), seeds)


def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the graph of regions, nations and suppliers."""
    g = graph.induced(data_graph(spark, d), data_graph(spark, d).nodes.filter("kind in ('region', 'nation', 'supplier')"))
    return graph.closure(graph.adjacency(g.edges, graph.UP))


def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    return graph.adjacency(g.edges, graph.UP).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def graph_induced(spark: SparkSession, d: str) -> DataFrame:
    return graph.select_kinds(data_graph(spark, d), "customer", "nation").edges.select("kind", "source_id", "target_id")


def graph_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_kind_counts(data_graph(spark, d))


def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = merge.merge_nodes(_customers(spark, d))
    return nodes.select("id", "kind", "name", "qualified_name", F.size("evidence").cast("long").alias("n_evidence"), F.col("aspects")["segment"].alias("segment"))


def _customers(spark: SparkSession, d: str) -> list[DataFrame]:
    from skeinwork.schemas import NODES

    t = _read(spark, d, "customer")
    evidence = lambda file: F.array(F.struct(F.lit(file).alias("file"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("expression"), F.lit("high").alias("confidence")))
    low = F.col("c_acctbal") < 0
    id_ = F.concat(F.lit("table:"), F.lower("c_name"))
    left = t.select(id_.alias("id"), F.lit("table").alias("kind"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("qualified_name"), evidence("a").alias("evidence"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("aspects"))
    right = t.select(id_.alias("id"), F.lit("table").alias("kind"), F.when(low, F.upper("c_mktsegment")).otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("db."), "c_name").alias("qualified_name"), F.when(low, evidence("a")).otherwise(evidence("b")).alias("evidence"), F.create_map(F.lit("segment"), F.when(low, F.lit("LOW")).otherwise(F.col("c_mktsegment"))).alias("aspects"))
    return [fill(left, NODES), fill(right, NODES)]


def merge_warnings(spark: SparkSession, d: str) -> DataFrame:
    _, warnings = merge.merge_nodes(_customers(spark, d))
    return warnings.select("code", "message", "subject_id")


def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lines as edges of two sources that disagree on the label."""
    t = _read(spark, d, "lineitem")
    keys = [F.lit("feeds").alias("kind"), _id("part", "l_partkey").alias("source_id"), _id("supplier", "l_suppkey").alias("target_id")]
    pair = t.groupBy("l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("low"), F.max("l_returnflag").alias("high"))
    # both sources come from one pass over the pairs
    sources = F.array(*[F.struct(F.lit(i).alias("_src"), F.col(c).alias("label"), F.lit("high").alias("confidence")) for i, c in enumerate(("low", "high"))])
    merged = merge.merged_edges(fill(pair.select(*keys, F.inline(sources)), f"{EDGES}, _src int"))
    return merged.select("source_id", "target_id", "label", F.size("warnings").cast("long").alias("n_warnings"))


def tier_match(spark: SparkSession, d: str) -> DataFrame:
    """Customers by name against tables named region.nation.customer, then by nation, which is ambiguous."""
    c = _read(spark, d, "customer").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    targets = c.select(F.concat(F.lit("table:"), F.lower("n_name"), F.lit("."), F.lower("c_name")).alias("target_id"), F.concat(F.lower("n_name"), F.lit("."), F.lower("c_name")).alias("name"))
    wrong = F.concat(F.lit("nowhere."), F.lower("c_name"))
    subjects = c.select(F.col("c_custkey").cast("string").alias("subject_id"), F.when(F.col("c_acctbal") < 0, F.array(wrong)).otherwise(F.array(wrong, F.lower("c_name"))).alias("candidates"))
    return match.match(subjects, targets)


def binding(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tables bound to a warehouse that has them under their nation."""
    c = _read(spark, d, "customer").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    full = F.concat(F.lower("n_name"), F.lit("."), F.lower("c_name"))
    bound = F.array(F.struct(F.lit("w").alias("warehouse"), F.lit(None).cast("string").alias("database"), F.lower("n_name").alias("schema"), F.lower("c_name").alias("table"), F.lit(None).cast("string").alias("column")))
    house = graph_of(spark, c.select(F.concat(F.lit("table:"), full).alias("id"), F.lit("table").alias("kind"), "c_name", full.alias("qualified_name"), bound.alias("bindings")).withColumnRenamed("c_name", "name"))
    name = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("x."), F.lower("c_name"))).otherwise(F.lower("c_name"))
    g = graph_of(spark, c.select(F.concat(F.lit("table:"), name).alias("id"), F.lit("table").alias("kind"), F.col("c_name").alias("name"), name.alias("qualified_name")))
    out = match.attach_bindings(g, house)
    codes = out.warnings.select(F.col("subject_id").alias("id"), "code")
    return out.nodes.join(codes, "id", "left").select("id", F.get("bindings", F.lit(0))["schema"].alias("bound_schema"), "code")


def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer isn't in the graph because the graph has suppliers in its place."""
    g = data_graph(spark, d)
    g = g.with_(nodes=g.nodes.filter("kind <> 'customer'"))
    return checks.edges_resolve(g).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


def duplicate_bindings(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    bound = F.array(F.struct(F.lit("w").alias("warehouse"), F.lit(None).cast("string").alias("database"), F.col("c_mktsegment").alias("schema"), F.col("c_nationkey").cast("string").alias("table"), F.lit(None).cast("string").alias("column")))
    nodes = c.select(F.format_string("customer:%09d", "c_custkey").alias("id"), F.lit("table").alias("kind"), F.col("c_name").alias("name"), bound.alias("bindings"))
    return checks.duplicate_bindings(graph_of(spark, nodes)).select("node_id", "message")


def duplicate_formulas(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "documents")
    nodes = t.select(F.format_string("metric:%09d", "doc_id").alias("id"), F.lit("metric").alias("kind"), F.lit("m").alias("name"), F.create_map(F.lit("metric"), F.to_json(F.struct(F.col("text").alias("formula")))).alias("aspects"))
    return checks.duplicate_formulas(graph_of(spark, nodes)).select("node_id", "message")


def posture(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all postures over the events as warnings."""
    e = _read(spark, d, "events")
    w = e.select(F.col("event_type").alias("code"), F.col("event_id").cast("string").alias("message"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject_id"))
    g = graph_of(spark, warnings=w)
    parts = [checks.warnings_as_findings(g).withColumn("severity", checks.severity(F.col("tier"), p)).groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn("posture", F.lit(p)) for p in ("strict", "standard", "permissive")]
    return reduce(DataFrame.unionByName, parts)


def policy_gate(spark: SparkSession, d: str) -> DataFrame:
    """Customers by segment as their kind, with rules on segments and a floor on negative balances."""
    c = _read(spark, d, "customer")
    aspects = F.when(F.col("c_acctbal") < 0, F.create_map(F.lit("classification"), F.lit('"pii"'))).otherwise(F.create_map(F.lit("note"), F.lit('"x"')))
    nodes = graph_of(spark, c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), aspects.alias("aspects"))).nodes
    rows = [("1", "rbac", "ana", "allow", "BUILDING"), ("2", "masking", "ana", "allow", "MACHINERY"), ("3", "rls", "ana", "allow", "FURNITURE"), ("4", "rbac", "ana", "deny", "HOUSEHOLD"), ("5", "rbac", "bob", "allow", None)]
    rules = spark.createDataFrame(rows, "id string, kind string, identity string, effect string, selector_kind string")
    return policy.gate(nodes, rules, "ana").select("id", "decision")


def policy_projection(spark: SparkSession, d: str) -> DataFrame:
    g = data_graph(spark, d)
    rules = spark.createDataFrame([("1", "rbac", "ana", "allow", "customer"), ("2", "masking", "ana", "allow", "nation")], "id string, kind string, identity string, effect string, selector_kind string")
    out = policy.apply_policy(g, rules, "ana")
    masked = F.map_contains_key("aspects", "_policy_masked")
    return out.nodes.groupBy("kind", masked.alias("masked")).agg(F.count(F.lit(1)).alias("n"))


def coverage_classes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as columns of their nation: flagged below zero, resolved with an order, else leaves or silent."""
    c, o = _read(spark, d, "customer"), _read(spark, d, "orders")
    id_ = lambda n, k: F.concat(F.lit("column:n"), F.col(n).cast("string"), F.lit(".c"), F.col(k).cast("string"))
    nodes = c.select(id_("c_nationkey", "c_custkey").alias("id"), F.lit("column").alias("kind"), F.col("c_name").alias("name"))
    edges = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("derives_from").alias("kind"), id_("c_nationkey", "c_custkey").alias("source_id"), F.concat(F.lit("column:o.k"), F.col("o_orderkey").cast("string")).alias("target_id"))
    warnings = c.filter("c_acctbal < 0").select(F.lit("unresolved_lineage").alias("code"), F.lit("m").alias("message"), id_("c_nationkey", "c_custkey").alias("subject_id"))
    n = _read(spark, d, "nation")
    roots = n.filter("n_regionkey = 0").select(F.concat(F.lit("table:n"), F.col("n_nationkey").cast("string")).alias("id"))
    return coverage_summary(coverage(graph_of(spark, nodes, edges, warnings), roots))


def derivation_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Customers stamped by their orders' statuses as warnings."""
    c, o = _read(spark, d, "customer"), _read(spark, d, "orders")
    nodes = c.select(F.concat(F.lit("table:c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("table").alias("kind"), F.col("c_name").alias("name"))
    code = F.when(F.col("o_orderstatus") == "P", "parse_failed").when(F.col("o_orderstatus") == "F", "select_star").otherwise("select_star_expanded")
    warnings = o.select(code.alias("code"), F.lit("m").alias("message"), F.concat(F.lit("table:c"), F.col("o_custkey").cast("string")).alias("subject_id"))
    return stamp(graph_of(spark, nodes, warnings=warnings)).nodes.groupBy("derivation.status", "derivation.confidence").agg(F.count(F.lit(1)).alias("n"))


def identity_functions(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.concat(F.lit(' "'), "n_name", F.lit('" . `'), "c_mktsegment", F.lit("`."), "c_name")
    return c.select("c_custkey", identity.make_id("table", raw).alias("table_id"), identity.leaf_name(raw).alias("leaf"), F.array_join(identity.fqn_candidates(raw), "|").alias("candidates"), identity.canonical_type(F.concat(F.lit(" VARCHAR("), F.col("c_custkey").cast("string"), F.lit(")"))).alias("type"))


def native_sql_tables(spark: SparkSession, d: str) -> DataFrame:
    n = _read(spark, d, "nation")
    sql = F.concat(F.lit("select * from Geo."), F.regexp_replace("n_name", " ", "_"), F.lit(" a join Region b on 1 = 1 join Region c on 1 = 1"))
    out = native_table_columns(n.select("n_nationkey", sql.alias("sql")), "sql")
    return out.select("n_nationkey", F.explode("tables").alias("t")).select("n_nationkey", "t.schema", "t.table")


def openlineage(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' parts as input fields of an output column per supplier."""
    t = _read(spark, d, "lineitem")
    edges = t.select(F.lit("derives_from").alias("kind"), F.concat(F.lit("column:s"), F.col("l_suppkey").cast("string"), F.lit(".parts")).alias("source_id"), F.concat(F.lit("column:part.p"), F.col("l_partkey").cast("string")).alias("target_id"))
    return openlineage_fields(graph_of(spark, edges=edges)).select("dataset", "column", F.size("inputs").cast("long").alias("n"), F.get("inputs", F.lit(0))["field"].alias("first_field"))


def edge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a discount against all lines, as edge sets."""
    t = _read(spark, d, "lineitem")
    edge = lambda df: df.select(F.lit("feeds").alias("kind"), F.col("l_partkey").cast("string").alias("source_id"), F.col("l_suppkey").cast("string").alias("target_id"))
    return merge.edge_set_scores(edge(t.filter("l_discount > 0.05")), edge(t)).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "jaccard")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (graph_reach, graph_closure, graph_neighbors, graph_induced, graph_edge_counts, merge_nodes, merge_warnings, merge_edges, tier_match, binding, dangling_edges, duplicate_bindings, duplicate_formulas, posture, policy_gate, policy_projection, coverage_classes, derivation_stamps, identity_functions, native_sql_tables, openlineage, edge_scores)
    return {f.__name__: f for f in found}


_EDGES = """
WITH e(kind, s, t) AS (
  SELECT 'references', 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'references', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'references', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'references', 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders
  UNION ALL SELECT 'feeds', 'orders:' || l_orderkey, 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT 'feeds', 'orders:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem
)
"""
SQL = {
    "graph_reach": """
        SELECT 'region:' || n_regionkey AS seed, 'nation:' || n_nationkey AS node_id, 1 AS depth FROM nation
        UNION ALL SELECT 'region:' || n_regionkey, 'customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'region:' || n_regionkey, 'supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'region:' || n_regionkey, 'orders:' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "graph_closure": """
        SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
        UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
        UNION SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "graph_neighbors": _EDGES + "SELECT s AS src, count(*) AS n FROM e GROUP BY s",
    "graph_induced": "SELECT 'references' AS kind, 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "graph_edge_counts": _EDGES + "SELECT kind, count(*) AS n FROM e GROUP BY kind",
    "merge_nodes": """
        SELECT 'table:' || lower(c_name) AS id, 'table' AS kind, c_name AS name, 'db.' || c_name AS qualified_name,
          CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END::BIGINT AS n_evidence, c_mktsegment AS segment FROM customer""",
    "merge_warnings": """
        SELECT 'source_disagreement' AS code, '''table:' || lower(c_name) || ''' differs by source in node.name: ''' || c_name || ''' vs ''' || upper(c_mktsegment) || '''' AS message, 'table:' || lower(c_name) AS subject_id FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 'source_disagreement', '''table:' || lower(c_name) || ''' differs by source in aspect ''segment''', 'table:' || lower(c_name) FROM customer WHERE c_acctbal < 0""",
    "merge_edges": """
        SELECT 'part:' || l_partkey AS source_id, 'supplier:' || l_suppkey AS target_id, min(l_returnflag) AS label,
          (min(l_returnflag) <> max(l_returnflag))::INT::BIGINT AS n_warnings FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "tier_match": """
        SELECT c_custkey::VARCHAR AS subject_id, CASE WHEN c_acctbal >= 0 THEN 'table:' || lower(n_name) || '.' || lower(c_name) END AS target_id,
          CASE WHEN c_acctbal >= 0 THEN 'resolved' ELSE 'unresolved' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "binding": """
        SELECT 'table:' || CASE WHEN c_acctbal < 0 THEN 'x.' ELSE '' END || lower(c_name) AS id, lower(n_name) AS bound_schema, NULL::VARCHAR AS code FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "dangling_edges": "SELECT 'customer:' || k AS node_id, count(*) AS n FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders) GROUP BY k",
    "duplicate_bindings": """
        SELECT printf('customer:%09d', c_custkey) AS node_id, '''' || printf('customer:%09d', c_custkey) || ''' is bound to (''w'', '''', ''' || c_mktsegment || ''', ''' || c_nationkey || ''', ''''), as ''' || printf('customer:%09d', f) || ''' is' AS message
        FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey) AS f FROM customer) WHERE c_custkey <> f""",
    "duplicate_formulas": """
        SELECT printf('metric:%09d', doc_id) AS node_id, '''' || printf('metric:%09d', doc_id) || ''' has the formula of ''' || printf('metric:%09d', f) || '''' AS message
        FROM (SELECT *, min(doc_id) OVER (PARTITION BY lower(trim(text, ' '))) AS f FROM documents WHERE trim(text, ' ') <> '') WHERE doc_id <> f""",
    "posture": """
        SELECT 'check.' || event_type AS check_id, s AS severity, count(*) AS n, p AS posture FROM events, (VALUES ('strict', 'warn'), ('standard', 'warn'), ('permissive', NULL)) v(p, s) GROUP BY event_type, s, p""",
    "policy_gate": """
        SELECT 'c:' || c_custkey AS id, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'filter' WHEN c_acctbal < 0 THEN 'deny' WHEN c_mktsegment = 'BUILDING' THEN 'allow' WHEN c_mktsegment = 'MACHINERY' THEN 'mask' ELSE 'deny' END AS decision FROM customer""",
    "policy_projection": "SELECT 'customer' AS kind, false AS masked, count(*) AS n FROM customer UNION ALL SELECT 'nation', true, count(*) FROM nation",
    "coverage_classes": """
        WITH k AS (
          SELECT CASE WHEN c_acctbal < 0 THEN 'flagged' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'resolved' WHEN n_regionkey = 0 THEN 'source_leaf' ELSE 'silent' END AS class
          FROM customer JOIN nation ON c_nationkey = n_nationkey
        ) SELECT count(*) AS total, count(*) FILTER (class = 'resolved') AS resolved, count(*) FILTER (class = 'flagged') AS flagged, count(*) FILTER (class = 'source_leaf') AS source_leaf, count(*) FILTER (class = 'silent') AS silent,
          round(100 * count(*) FILTER (class = 'resolved') / count(*), 2) AS resolved_percent, round(100 * count(*) FILTER (class = 'flagged') / count(*), 2) AS flagged_percent,
          round(100 * count(*) FILTER (class = 'source_leaf') / count(*), 2) AS source_leaf_percent, round(100 * count(*) FILTER (class = 'silent') / count(*), 2) AS silent_percent FROM k""",
    "derivation_stamps": """
        WITH s AS (SELECT c_custkey, coalesce(bool_or(o_orderstatus = 'P'), false) AS p, coalesce(bool_or(o_orderstatus = 'F'), false) AS f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
        SELECT CASE WHEN p THEN 'failed' WHEN f THEN 'partial' ELSE 'complete' END AS status, CASE WHEN p THEN 'low' WHEN f THEN 'medium' ELSE 'high' END AS confidence, count(*) AS n FROM s GROUP BY ALL""",
    "identity_functions": """
        SELECT c_custkey, 'table:' || lower(n_name) || '.' || lower(c_mktsegment) || '.' || lower(c_name) AS table_id, c_name AS leaf,
          lower(n_name || '.' || c_mktsegment || '.' || c_name || '|' || c_mktsegment || '.' || c_name || '|' || c_name) AS candidates, 'varchar' AS type FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "native_sql_tables": """
        SELECT n_nationkey, 'Geo' AS schema, lower(replace(n_name, ' ', '_')) AS table FROM nation UNION ALL SELECT n_nationkey, NULL, 'region' FROM nation""",
    "openlineage": """
        SELECT 's' || l_suppkey AS dataset, 'parts' AS column, count(DISTINCT l_partkey) AS n, min('p' || l_partkey) AS first_field FROM lineitem GROUP BY l_suppkey""",
    "edge_scores": """
        WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.05), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
        SELECT 1.0::DOUBLE AS precision, round((SELECT count(*) FROM a) / (SELECT count(*) FROM b), 9) AS recall, round((SELECT count(*) FROM a) / (SELECT count(*) FROM b), 9) AS jaccard""",
}
