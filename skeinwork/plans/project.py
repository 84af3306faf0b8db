"""Compilation of a project of SQL models into a graph.

Statements are parsed and resolved on the driver, level by level of the model graph; what comes out
are rows, and everything after that (warnings, coverage, stamping, status) works on DataFrames.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.identity import column_selection, dataset_of
from skeinwork.plans.parsing import Tree, parse
from skeinwork.plans.values import Output, Ref, Resolved, Resolver, table_refs
from skeinwork.schemas import EDGES, NODES, WARNINGS, Graph, GraphError, fill, struct

SOURCE = "spark_plan"
# Warning code -> finding of the resolver status.
FINDING_OF = {
    "unresolved_lineage": "unresolved_output",
    "unresolved_output_source": "unresolved_output",
    "unresolved_star_source": "unresolved_star",
    "select_star": "suppressed_star",
    "schema_missing": "schema_missing",
    "lineage_resolution_failed": "parse_failed",
    "dependency_cycle": "dependency_cycle",
}


@dataclass
class Dataset:
    """A model (``local``, with SQL) or an external table (``root``)."""

    name: str
    kind: str = "local"
    sql: str | None = None
    dependencies: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    file: str | None = None


def with_roots(datasets: list[Dataset]) -> list[Dataset]:
    """The datasets, and an empty root for every dependency that none of them is."""
    names = {d.name for d in datasets}
    lost = sorted({x for d in datasets for x in d.dependencies} - names)
    return [*datasets, *[Dataset(x, "root") for x in lost]]


def levels(dependencies: dict[str, list[str]]) -> tuple[list[list[str]], list[str]]:
    """Models by their longest path from the roots, each level sorted; and those on or behind a cycle."""
    left = {k: {d for d in v if d in dependencies and d != k} | ({k} if k in v else set()) for k, v in dependencies.items()}
    out = []
    while True:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            return out, sorted(left)
        out.append(ready)
        for k in ready:
            del left[k]
        for v in left.values():
            v.difference_update(ready)


@dataclass
class Compiled:
    """What one model gave."""

    dataset: Dataset
    result: Resolved | None = None
    refs: list[str] = field(default_factory=list)
    warnings: list[tuple[str, str, str | None]] = field(default_factory=list)  # code, message, subject
    edges: list[tuple[str, Ref, str]] = field(default_factory=list)  # output, source, confidence

    def warn(self, code: str, message: str, subject: str | None = None) -> None:
        self.warnings.append((code, message, subject))


def compile_model(spark: SparkSession, d: Dataset, schemas: dict[str, list[str]], dialect: str) -> Compiled:
    """Value lineage of one model. Anything that can't be traced is a warning, never an error."""
    out = Compiled(d)
    try:
        tree = parse(spark, d.sql or "", dialect)
    except GraphError as e:
        out.warn("lineage_resolution_failed", f"{d.name}: {e}", f"table:{d.name}")
        return out
    out.refs = table_refs(tree)
    resolver = Resolver({k: v for k, v in schemas.items() if v and k != d.name})
    result = out.result = resolver.resolve(tree)
    if result.suppressed:
        out.warn("select_star", f"{d.name}: columns of a star are not traced", f"table:{d.name}")
        if result.unknown_star:
            out.warn("unresolved_star_source", f"{d.name}: the relation of a star has no known columns", f"table:{d.name}")
    elif result.expanded:
        out.warn("select_star_expanded", f"{d.name}: a star was expanded from known columns", f"table:{d.name}")
    for o in result.outputs:
        subject = f"column:{d.name}.{o.name}"
        if result.open_union or o.quoted:
            o.refs = frozenset()
            out.warn("unresolved_lineage", f"{subject}: {'a union of different relations' if result.open_union else 'a quoted name'} is not traced", subject)
        elif not o.refs:
            out.warn("unresolved_output_source", f"{subject}: no column's value flows into it", subject)
            out.warn("unresolved_lineage", f"{subject}: no upstream column was found", subject)
        else:
            out.edges += [(o.name, ref, "high" if not o.star else "medium") for ref in sorted(o.refs)]
    for name in d.columns:
        if result.column(name) is None and not result.suppressed:
            out.warn("unresolved_lineage", f"column:{d.name}.{name}: declared but not an output", f"column:{d.name}.{name}")
    return out


def status_of(c: Compiled, cyclic: bool) -> tuple[str, list[str]]:
    """The resolver status of a model and its findings, in the order of its warnings."""
    codes = [w[0] for w in c.warnings]
    findings = list(dict.fromkeys(FINDING_OF[x] for x in codes if x in FINDING_OF))
    n = len(c.result.outputs) if c.result else 0
    if cyclic or not c.dataset.sql or (c.result and c.result.open_union and not c.edges):
        return "unsupported", findings
    if "lineage_resolution_failed" in codes:
        return "parse_failed", findings
    if not c.edges:
        return ("schema_missing" if c.result and c.result.unknown_star else "partial"), findings
    traced = len({e[0] for e in c.edges})
    if findings or traced < n:
        return "partial", findings
    return "complete", findings


def compile_project(spark: SparkSession, datasets: list[Dataset], dialect: str = "") -> Graph:
    """The graph of a project: tables, columns, ``depends_on`` and ``derives_from`` edges, warnings, statuses."""
    datasets = with_roots(datasets)
    by_name = {d.name: d for d in datasets}
    if len(by_name) < len(datasets):
        raise GraphError("a dataset name is given twice")
    local = {d.name: d for d in datasets if d.kind == "local"}
    order, cyclic = levels({k: d.dependencies for k, d in local.items()})
    schemas = {d.name: list(dict.fromkeys([*d.columns, *d.types])) for d in datasets}
    done: dict[str, Compiled] = {}
    for level in order:
        for name in level:
            c = done[name] = compile_model(spark, local[name], schemas, dialect)
            if c.result and not c.result.suppressed and c.result.outputs:
                schemas[name] = [o.name for o in c.result.outputs]
    for name in cyclic:
        c = done[name] = Compiled(local[name])
        c.warn("dependency_cycle", f"{name} is on or behind a cycle of dependencies", f"table:{name}")
    return _rows(spark, datasets, done, set(cyclic), schemas)


def _rows(spark: SparkSession, datasets: list[Dataset], done: dict[str, Compiled], cyclic: set[str], schemas: dict[str, list[str]]) -> Graph:
    nodes, edges, warnings = {}, [], []
    for d in datasets:
        c = done.get(d.name)
        aspects = None
        if c:
            status, findings = status_of(c, d.name in cyclic)
            record = {"status": status, "outputs": len(c.result.outputs) if c.result else 0, "edges": len(c.edges), "unknown_edges_possible": status != "complete", "blocking_findings": findings}
            aspects = {"lineage_resolution": json.dumps(record, sort_keys=True)}
        nodes[f"table:{d.name}"] = (f"table:{d.name}", "table", d.name.split(".")[-1], d.name, aspects)
        for column in dict.fromkeys([*schemas[d.name], *d.columns, *([o.name for o in c.result.outputs] if c and c.result else [])]):
            nodes[f"column:{d.name}.{column}"] = (f"column:{d.name}.{column}", "column", column, f"{d.name}.{column}", None)
        for dep in dict.fromkeys(d.dependencies):
            edges.append(("depends_on", f"table:{d.name}", f"table:{dep}", "high", d.file, None))
        if c:
            for column, (relation, source), confidence in c.edges:
                edges.append(("derives_from", f"column:{d.name}.{column}", f"column:{relation}.{source}", confidence, d.file, column))
                for id_, kind, name, full in ((f"column:{relation}.{source}", "column", source, f"{relation}.{source}"), (f"table:{relation}", "table", relation.split(".")[-1], relation)):
                    nodes.setdefault(id_, (id_, kind, name, full, None))
            warnings += [(code, message, d.file, subject) for code, message, subject in c.warnings]
    n = spark.createDataFrame(list(nodes.values()), "id string, kind string, name string, qualified_name string, aspects map<string,string>")
    e = spark.createDataFrame(edges, "kind string, source_id string, target_id string, sure string, file string, expression string")
    evidence = F.when(F.col("file").isNotNull() | F.col("expression").isNotNull(), F.array(F.struct("file", F.lit(None).cast("string").alias("location"), "expression", F.col("sure").alias("confidence"))))
    e = fill(e.withColumn("evidence", evidence).withColumn("confidence", F.lit("high")), EDGES)
    w = spark.createDataFrame(warnings, struct(WARNINGS)).dropDuplicates()
    return stamp(Graph(fill(n, NODES), e, w))


def stamp(g: Graph) -> Graph:
    """The derivation of tables and columns, from the warnings on them, on their table or on its file."""
    about = g.warnings.select("code", F.explode(F.array_distinct(F.filter(F.array("subject_id", F.concat(F.lit("table:"), dataset_of(F.col("location")))), lambda x: x.isNotNull()))).alias("id"))
    flags = about.groupBy("id").agg(F.bool_or(F.col("code").endswith("_failed")).alias("failed"), F.bool_or(~F.col("code").endswith("_failed") & (F.col("code") != "select_star_expanded")).alias("partial"), F.array_sort(F.collect_set("code")).alias("codes"))
    owner = F.when(F.col("kind") == "column", F.concat(F.lit("table:"), column_selection(F.col("id"))["dataset"]))
    table_flags = flags.select(F.col("id").alias("owner"), F.col("failed").alias("t_failed"), F.col("partial").alias("t_partial"))
    nodes = g.nodes.withColumn("owner", owner).join(flags, "id", "left").join(table_flags, "owner", "left")
    yes = lambda a, b: F.coalesce(F.col(a), F.lit(False)) | F.coalesce(F.col(b), F.lit(False))
    level = F.when(yes("failed", "t_failed"), F.struct(F.lit("failed"), F.lit("low"))).when(yes("partial", "t_partial"), F.struct(F.lit("partial"), F.lit("medium"))).otherwise(F.struct(F.lit("complete"), F.lit("high")))
    derivation = F.struct(level["col1"].alias("status"), level["col2"].alias("confidence"), F.lit(SOURCE).alias("source"), F.coalesce("codes", F.array().cast("array<string>")).alias("errors"))
    stamped = F.when(F.col("kind").isin("table", "column"), F.coalesce("derivation", derivation)).otherwise(F.col("derivation"))
    return g.with_(nodes=nodes.withColumn("derivation", stamped).select(*g.nodes.columns))


def coverage(g: Graph, roots: DataFrame) -> DataFrame:
    """(id, class) of columns: flagged by a warning of its own, resolved by an edge, flagged by its table's star, source_leaf of a root, or silent.

    ``roots``: the ids of root tables.
    """
    columns = g.nodes.filter("kind = 'column'").select("id", F.concat(F.lit("table:"), column_selection(F.col("id"))["dataset"]).alias("table"))
    own = g.warnings.filter("subject_id like 'column:%'").select(F.col("subject_id").alias("id")).distinct().withColumn("own", F.lit(True))
    star = g.warnings.filter("code in ('select_star', 'unresolved_star_source')").select(F.col("subject_id").alias("table")).distinct().withColumn("star", F.lit(True))
    up = g.edges.filter("kind = 'derives_from'").select(F.col("source_id").alias("id")).distinct().withColumn("up", F.lit(True))
    root = roots.select(F.col("id").alias("table")).distinct().withColumn("root", F.lit(True))
    all_ = columns.join(own, "id", "left").join(up, "id", "left").join(star, "table", "left").join(root, "table", "left")
    kind = F.when(F.col("own"), "flagged").when(F.col("up"), "resolved").when(F.col("star") & F.col("root").isNull(), "flagged").when(F.col("root"), "source_leaf").otherwise("silent")
    return all_.select("id", kind.alias("class"))


def coverage_summary(classes: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    count = lambda c: F.count_if(F.col("class") == c)
    names = ("resolved", "flagged", "source_leaf", "silent")
    return classes.agg(n.alias("total"), *[count(c).alias(c) for c in names], *[F.round(100 * count(c) / F.greatest(n, F.lit(1)), 2).alias(f"{c}_percent") for c in names])


def status_summary(g: Graph) -> DataFrame:
    """Models per resolver status."""
    status = F.get_json_object(F.col("aspects")["lineage_resolution"], "$.status")
    return g.nodes.filter("kind = 'table'").select(status.alias("status")).filter("status is not null").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def predicate_usage(tree: Tree, column: str) -> str | None:
    """How a column that is no output is used: join, filter, grouping or ordering, the first that applies."""
    places: dict[str, list[Tree]] = {"join": [], "filter": [], "grouping": [], "ordering": []}
    for t in tree.walk():
        if t.kind == "Join" and "condition" in t.parts:
            places["join"].append(t.parts["condition"])
        elif t.kind in ("Filter", "UnresolvedHaving"):
            places["filter"].append(t.parts["condition"])
        elif t.kind == "Aggregate":
            places["grouping"] += t.parts["grouping"]
        elif t.kind == "Sort":
            places["ordering"] += t.parts["order"]
    for name, expressions in places.items():
        if any(x.kind == "UnresolvedAttribute" and x.parts["names"][-1].lower() == column.lower() for e in expressions for x in e.walk()):
            return name
    return None


def scoped(datasets: list[Dataset], targets: list[str]) -> list[Dataset]:
    """The datasets that some targets need, themselves included; unknown targets raise."""
    by_name = {d.name: d for d in datasets}
    lost = sorted(set(targets) - set(by_name))
    if lost:
        raise GraphError(f"unknown datasets: {', '.join(lost)}")
    seen: set[str] = set()
    todo = list(targets)
    while todo:
        at = todo.pop()
        if at not in seen and at in by_name:
            seen.add(at)
            todo += by_name[at].dependencies
    return [d for d in datasets if d.name in seen]


def fingerprint(datasets: list[Dataset]) -> str:
    """A digest of everything that a compilation depends on."""
    import hashlib
    from dataclasses import asdict

    return hashlib.sha256(json.dumps([asdict(d) for d in sorted(datasets, key=lambda d: d.name)], sort_keys=True).encode()).hexdigest()


__all__ = ["Compiled", "Dataset", "Output", "compile_model", "compile_project", "coverage", "coverage_summary", "fingerprint", "levels", "predicate_usage", "scoped", "stamp", "status_of", "status_summary", "with_roots"]
