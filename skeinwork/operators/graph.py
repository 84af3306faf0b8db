"""Graph queries on edge relations: adjacency, reachability, closure, selection, counts, impact."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.identity import column_selection, dataset_of
from skeinwork.schemas import Graph, GraphError, struct

UP, DOWN = "upstream", "downstream"
#: A frontier of up to so many nodes is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def _stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop's state through the session's checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="skeinwork-graph-")
        spark.sparkContext.setCheckpointDir(f"{folder}/{uuid.uuid4().hex}")
    return df.checkpoint()


def stored(g: Graph) -> Graph:
    """The graph computed once and cut from its lineage, for many queries after it."""
    return g.with_(nodes=_stored(g.nodes), edges=_stored(g.edges), warnings=_stored(g.warnings))


def node(g: Graph, id_: str) -> DataFrame:
    """The node of an id; raises if there is none."""
    found = g.nodes.filter(F.col("id") == id_)
    if found.isEmpty():
        raise GraphError(f"unknown node: {id_}")
    return found


def has_node(g: Graph, id_: str) -> bool:
    return not g.nodes.filter(F.col("id") == id_).isEmpty()


def of_kind(df: DataFrame, *kinds: str) -> DataFrame:
    return df.filter(F.col("kind").isin(*kinds))


def adjacency(edges: DataFrame, direction: str, kind: str | None = None) -> DataFrame:
    """(src, dst) steps: upstream from source to target, downstream back. Repeats stay."""
    if direction not in (UP, DOWN):
        raise GraphError(f"unknown direction: {direction!r}")
    if kind is not None:
        edges = edges.filter(F.col("kind") == kind)
    ends = ("source_id", "target_id") if direction == UP else ("target_id", "source_id")
    return edges.select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"))


def neighbors(edges: DataFrame, id_: str, direction: str, kind: str | None = None) -> DataFrame:
    return adjacency(edges, direction, kind).filter(F.col("src") == id_).select(F.col("dst").alias("node_id"))


def reach(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node_id, depth) of all nodes that a seed reaches over (src, dst), at their least depth.

    A seed is in its own result only if it lies on a cycle. The frontier of a round is each node once, so cycles
    end and diamonds cost nothing; a round is a join with the frontier and an anti-join with what was seen.
    """
    steps = steps.distinct()
    frontier = _stored(seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("at")).distinct())
    found: DataFrame | None = None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        small = frontier.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        side = F.broadcast(frontier) if small else frontier
        ahead = steps.join(side, steps["src"] == frontier["at"]).select("seed", F.col("dst").alias("node_id")).distinct()
        if found is not None:
            ahead = ahead.join(found.select("seed", "node_id"), ["seed", "node_id"], "left_anti")
        ahead = _stored(ahead.withColumn("depth", F.lit(depth)))
        if ahead.isEmpty():
            break
        found = ahead if found is None else found.unionByName(ahead)
        frontier = ahead.select("seed", F.col("node_id").alias("at"))
    if found is None:
        return steps.sparkSession.createDataFrame([], struct("seed string, node_id string, depth int"))
    return found


def closure(steps: DataFrame) -> DataFrame:
    """(src, dst) of all pairs connected by a path: path doubling, as many rounds as the logarithm of the longest path. For graphs whose pairs are few."""
    paths = _stored(steps.select("src", "dst").distinct())
    size = paths.count()
    while True:
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        paths = _stored(paths.union(longer).distinct())
        grown = paths.count()
        if grown == size:
            return paths
        size = grown


@dataclass(frozen=True)
class Traversal:
    """A selection's reach: related (node_id, depth), the edges that leave visited nodes, warnings, completeness."""

    selection_id: str
    direction: str
    related: DataFrame
    edges: DataFrame
    warnings: DataFrame
    completeness: str | None = None
    unknown_edges_possible: bool | None = None
    blocking_findings: tuple[str, ...] = ()


def edge_kind_for(id_: str) -> str:
    """Columns are walked over derives_from, metrics and queries over depends_on."""
    kind = id_.partition(":")[0]
    if kind == "column":
        return "derives_from"
    if kind in ("metric", "query"):
        return "depends_on"
    raise GraphError(f"can't trace a {kind}: {id_}")


def subgraph(g: Graph, start: str, direction: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """related (node_id, depth), the nodes visited with the start, and the edges that leave them, once."""
    spark = g.nodes.sparkSession
    seed = spark.createDataFrame([(start,)], "node_id string")
    related = reach(adjacency(g.edges, direction, kind), seed).select("node_id", "depth")
    visited = related.select("node_id").union(seed).distinct()
    leave = "source_id" if direction == UP else "target_id"
    edges = g.edges.filter(F.col("kind") == kind).dropDuplicates(["kind", "source_id", "target_id"])
    return related, visited, edges.join(visited, edges[leave] == visited["node_id"], "left_semi")


def warnings_for(g: Graph, subject: str) -> DataFrame:
    """The subject's warnings; only if it has none, those without a subject whose file is the subject's dataset."""
    exact = g.warnings.filter(F.col("subject_id") == subject)
    if not exact.isEmpty():
        return exact
    dataset = F.coalesce(column_selection(F.lit(subject))["dataset"], F.substring_index(F.lit(subject), ":", -1))
    return g.warnings.filter(F.col("subject_id").isNull() & (dataset_of(F.col("location")) == dataset))


def trace(g: Graph, start: str, direction: str) -> Traversal:
    kind = edge_kind_for(start)
    node(g, start)
    related, _, edges = subgraph(g, start, direction, kind)
    return Traversal(start, direction, related, edges, warnings_for(g, start))


def select_kinds(g: Graph, *kinds: str, clear_warnings: bool = False) -> Graph:
    return induced(g, g.nodes.filter(F.col("kind").isin(*kinds)), clear_warnings)


def select(g: Graph, selector: str, clear_warnings: bool = False) -> Graph:
    """``kind:x``, ``id:prefix`` or a bare kind."""
    head, colon, rest = selector.partition(":")
    if not selector.strip() or (colon and (head not in ("kind", "id") or not rest)):
        raise GraphError(f"unknown selector: {selector!r}")
    if head == "id" and colon:
        return induced(g, g.nodes.filter(F.col("id").startswith(rest)), clear_warnings)
    return select_kinds(g, rest if colon else head, clear_warnings=clear_warnings)


def induced(g: Graph, nodes: DataFrame, clear_warnings: bool = False) -> Graph:
    """The graph of some nodes: edges with both ends, warnings about them or about nothing."""
    ids = nodes.select("id").distinct()
    edges = g.edges.join(ids, g.edges["source_id"] == ids["id"], "left_semi")
    edges = edges.join(ids, edges["target_id"] == ids["id"], "left_semi")
    about = g.warnings.filter("subject_id is not null").join(ids, F.col("subject_id") == ids["id"], "left_semi")
    warnings = g.warnings.limit(0) if clear_warnings else about.unionByName(g.warnings.filter("subject_id is null"))
    return g.with_(nodes=nodes, edges=edges, warnings=warnings)


def edge_kind_counts(g: Graph) -> DataFrame:
    return g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def derives_from_counts(g: Graph) -> DataFrame:
    """derives_from edges per dataset of their source."""
    dataset = column_selection(F.col("source_id"))["dataset"]
    return g.edges.filter("kind = 'derives_from'").groupBy(dataset.alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


def completeness(g: Graph, related: DataFrame) -> DataFrame:
    """One row: completeness, unknown_edges_possible, findings, for the related columns' tables.

    A table's ``lineage_resolution`` aspect names its status. Any that isn't complete makes it partial, all complete is
    complete, no column at all unknown; a missing aspect means that edges may be unknown.
    """
    tables = related.select(F.concat(F.lit("table:"), column_selection(F.col("node_id"))["dataset"]).alias("id")).filter("id is not null").distinct()
    found = tables.join(g.nodes.select("id", F.col("aspects")["lineage_resolution"].alias("aspect")), "id", "left")
    status = F.get_json_object("aspect", "$.status")
    findings = F.when(F.col("aspect").isNull(), F.array(F.lit("missing_lineage_resolution"))).otherwise(F.coalesce(F.from_json(F.get_json_object("aspect", "$.blocking_findings"), "array<string>"), F.array()))
    stats = found.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(status != "complete").alias("bad"),
        F.bool_and(F.coalesce(status == "complete", F.lit(False))).alias("all_good"),
        F.bool_or(F.col("aspect").isNull() | (F.coalesce(F.get_json_object("aspect", "$.unknown_edges_possible"), F.lit("false")) == "true")).alias("unknown"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(findings)))).alias("findings"),
    )
    level = F.when(F.col("n") == 0, "unknown").when(F.coalesce("bad", F.lit(False)), "partial").when(F.col("all_good"), "complete").otherwise("unknown")
    return stats.select(level.alias("completeness"), F.coalesce("unknown", F.lit(True)).alias("unknown_edges_possible"), "findings")


def impact(g: Graph, start: str, direction: str = DOWN) -> Traversal:
    """A trace with its completeness; anything but complete adds a ``partial_lineage_impact`` warning."""
    t = trace(g, start, direction)
    row = completeness(g, t.related).first()
    warnings = t.warnings
    if row.completeness != "complete":
        message = f"Impact of {start} may be incomplete (resolver completeness: {row.completeness})"
        warnings = warnings.unionByName(g.nodes.sparkSession.createDataFrame([("partial_lineage_impact", message, None, start)], warnings.schema))
    return Traversal(t.selection_id, direction, t.related, t.edges, warnings, row.completeness, row.unknown_edges_possible, tuple(row.findings))


def mermaid(edges: list[tuple[str, str]]) -> str:
    """A flowchart of (source, target) pairs of a collected subgraph."""
    name = lambda x: "n_" + "".join(c if c.isalnum() else "_" for c in x)
    lines = ["flowchart LR"]
    for x in sorted({x for e in edges for x in e}):
        lines.append(f'  {name(x)}["{x}"]')
    return "\n".join([*lines, *[f"  {name(a)} --> {name(b)}" for a, b in sorted(edges)]]) + "\n"


def tree(start: str, steps: list[tuple[str, str]]) -> str:
    """An indented tree of a collected subgraph; a node on the way to itself is marked."""
    ahead: dict[str, list[str]] = {}
    for a, b in sorted(set(steps)):
        ahead.setdefault(a, []).append(b)
    lines: list[str] = []
    todo = [(start, 0, frozenset())]
    while todo:
        at, depth, above = todo.pop()
        cycle = at in above
        lines.append("  " * depth + at + " (cycle)" * cycle)
        if not cycle:
            todo += [(b, depth + 1, above | {at}) for b in reversed(ahead.get(at, []))]
    return "\n".join(lines) + "\n"


def spark_of(g: Graph) -> SparkSession:
    return g.nodes.sparkSession
