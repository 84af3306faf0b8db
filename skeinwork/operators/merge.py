"""Keyed union of graphs with conflict reports: the first source wins.

Order is explicit (source ordinal), so results don't depend on partitions. One shuffle per relation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.identity import binding_key
from skeinwork.schemas import Graph, GraphError

_RANKED = "source_disagreement"


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)])


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(value, F.lit("")), F.lit("'"))


def _given(values: Column) -> Column:
    """The distinct values that aren't blank, first ones first."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def _not_null(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _others(distinct: Column) -> Column:
    """Distinct values after the first one."""
    return F.slice(distinct, F.lit(2), F.greatest(F.size(distinct), F.lit(0)))


def _with_parts(g: DataFrame, nodes: bool) -> DataFrame:
    """Working columns, each computed once: given derivations with their states, and for nodes all bindings and aspects with their keys."""
    rows = F.col("rows")
    state = lambda d: F.concat(d["status"], F.lit("/"), d["confidence"])
    g = g.withColumn("_derivations", _not_null(rows["derivation"]))
    states = F.transform("_derivations", state)
    g = g.withColumn("_states", F.when(F.size("_derivations") > 1, F.array_distinct(F.filter(states, lambda s: s != state(_first(F.col("_derivations")))))))
    if not nodes:
        return g
    g = g.withColumn("_bindings", F.flatten(_not_null(rows["bindings"])))
    g = g.withColumn("_binding_keys", F.transform("_bindings", binding_key))
    g = g.withColumn("_aspects", F.flatten(F.transform(_not_null(rows["aspects"]), F.map_entries)))
    return g.withColumn("_aspect_keys", F.col("_aspects")["key"])


def _merged_bindings() -> tuple[Column, Column]:
    """First binding of each key, and the keys of those that differ from an earlier one of their key."""
    place = lambda b: F.array_position("_binding_keys", binding_key(b))
    kept = F.filter("_bindings", lambda b, i: place(b) == i + 1)
    clash = F.filter("_bindings", lambda b: ~b.eqNullSafe(F.element_at("_bindings", place(b).cast("int"))))
    return F.when(F.size("_bindings") > 0, kept), F.when(F.size("_bindings") > 1, F.transform(clash, binding_key))


def _merged_aspects() -> tuple[Column, Column]:
    place = lambda e: F.array_position("_aspect_keys", e["key"])
    kept = F.filter("_aspects", lambda e, i: place(e) == i + 1)
    clash = F.filter("_aspects", lambda e: e["value"] != F.element_at("_aspects", place(e).cast("int"))["value"])
    return F.when(F.size("_aspects") > 0, F.map_from_entries(kept)), F.when(F.size("_aspects") > 1, F.array_distinct(clash["key"]))


def _evidence(rows: Column) -> Column:
    return F.array_distinct(F.flatten(_not_null(rows["evidence"])))


def _warned(code: str, values: Column, message: Callable[[Column], Column], subject: Column) -> Column:
    """A warning per value; none for null."""
    row = lambda v: F.struct(F.lit(code).alias("code"), message(v).alias("message"), F.lit(None).cast("string").alias("location"), subject.alias("subject_id"))
    return F.when(F.size(values) > 0, F.transform(values, row)).otherwise(F.array())


def _differs(distinct: Column, start: Column, subject: Column) -> Column:
    return _warned(_RANKED, _others(distinct), lambda v: F.concat(start, _quoted(_first(distinct)), F.lit(" vs "), _quoted(v)), subject)


def _unpacked(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return merged.drop("warnings"), merged.select(F.inline("warnings"))


def _grouped(stacked: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key with its sources' ``rows`` in their order."""
    rest = [c for c in stacked.columns if c not in keys and c != "_src"]
    rows = F.collect_list(F.struct("_src", F.struct(*rest).alias("r")))
    # the hash decides most comparisons of a sort; sources are few; a key's rows are as many as its sources, and repeats within one
    g = stacked.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(rows.alias("rows")).drop("_hash")
    ordered = F.array_sort("rows", lambda a, b: (a["_src"] - b["_src"]).cast("int"))
    return g.withColumn("rows", F.when(F.size("rows") > 1, ordered).otherwise(F.col("rows"))).withColumn("rows", F.col("rows")["r"])


def merged_nodes(stacked: DataFrame) -> DataFrame:
    """Nodes of all sources, ``_src`` is a source's place, merged by id, each with its ``warnings``. Differing kinds of an id raise."""
    rows, id_ = F.col("rows"), F.col("id")
    g = _with_parts(_grouped(stacked, ["id"]), nodes=True)
    g = g.withColumn("_names", F.array_distinct(rows["name"])).withColumn("_qualified", _given(rows["qualified_name"])).withColumn("_schemas", _given(rows["schema"]))
    names, qualified, schemas = F.col("_names"), F.col("_qualified"), F.col("_schemas")
    kinds = F.array_distinct(rows["kind"])
    problem = F.concat(_quoted(id_), F.lit(" is of several kinds: "), F.array_join(kinds, ", "))
    kind = F.when(F.size(kinds) > 1, F.raise_error(problem)).otherwise(_first(kinds))
    bindings, drift = _merged_bindings()
    aspects, clash = _merged_aspects()
    derivation, states = _first(F.col("_derivations")), F.col("_states")
    start = lambda what: F.concat(_quoted(id_), F.lit(f" differs by source in {what}: "))
    own = F.when(id_.startswith("column:") | id_.startswith("table:"), id_)
    warnings = [
        _differs(names, start("node.name"), id_),
        _warned(_RANKED, states, lambda s: F.concat(start("derivation"), derivation["status"], F.lit("/"), derivation["confidence"], F.lit(" vs "), s), id_),
        _warned(_RANKED, clash, lambda k: F.concat(_quoted(id_), F.lit(" differs by source in aspect "), _quoted(k)), id_),
        _warned("schema_drift", drift, lambda k: F.concat(_quoted(id_), F.lit(" is bound differently by source at ("), F.concat_ws(", ", *[_quoted(k[f]) for f in ("warehouse", "database", "schema", "table", "column")]), F.lit(")")), id_),
        _differs(qualified, start("node.qualified_name"), own),
        _differs(schemas, start("node.schema"), own),
    ]
    return g.select(
        "id",
        kind.cast("string").alias("kind"),
        _first(names).alias("name"),
        _first(qualified).alias("qualified_name"),
        _first(schemas).alias("schema"),
        _evidence(rows).alias("evidence"),
        derivation.alias("derivation"),
        bindings.alias("bindings"),
        aspects.alias("aspects"),
        F.concat(*warnings).alias("warnings"),
    )


def merge_nodes(frames: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes merged by id, and warnings. Differing kinds of an id raise."""
    return _unpacked(merged_nodes(_stack(frames)))


def merged_edges(stacked: DataFrame) -> DataFrame:
    """Edges of all sources, ``_src`` is a source's place, merged by (kind, source_id, target_id), each with its ``warnings``."""
    rows = F.col("rows")
    g = _with_parts(_grouped(stacked, ["kind", "source_id", "target_id"]), nodes=False)
    g = g.withColumn("_labels", _given(rows["label"])).withColumn("_statuses", _given(rows["match_status"])).withColumn("_confidences", F.array_distinct(rows["confidence"]))
    labels, statuses, confidences = F.col("_labels"), F.col("_statuses"), F.col("_confidences")
    derivation, states = _first(F.col("_derivations")), F.col("_states")
    pair = F.concat("source_id", F.lit("->"), "target_id")
    own = F.when(pair.startswith("column:") | pair.startswith("table:"), pair)
    source = F.col("source_id")
    warnings = [
        _differs(confidences, F.concat(F.lit("Edge "), _quoted(pair), F.lit(" of kind "), "kind", F.lit(" differs by source in confidence: ")), source),
        _warned(_RANKED, states, lambda s: F.concat(_quoted(source), F.lit(" differs by source in derivation: "), derivation["status"], F.lit("/"), derivation["confidence"], F.lit(" vs "), s), source),
        _differs(labels, F.concat(F.lit("Edge "), _quoted(pair), F.lit(" differs by source in label: ")), own),
        _differs(statuses, F.concat(F.lit("Edge "), _quoted(pair), F.lit(" differs by source in match_status: ")), own),
    ]
    return g.select(
        "kind",
        "source_id",
        "target_id",
        _first(labels).alias("label"),
        _first(confidences).alias("confidence"),
        _first(statuses).alias("match_status"),
        _evidence(rows).alias("evidence"),
        derivation.alias("derivation"),
        F.concat(*warnings).alias("warnings"),
    )


def merge_edges(frames: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Edges merged by (kind, source_id, target_id), and warnings."""
    return _unpacked(merged_edges(_stack(frames)))


def merge(*graphs: Graph) -> Graph:
    """The union of the graphs; warnings are distinct. Differing versions raise."""
    versions = {g.version for g in graphs if g.version}
    if len(versions) > 1:
        raise GraphError(f"can't merge graphs of versions {sorted(versions)}")
    nodes, w1 = merge_nodes([g.nodes for g in graphs])
    edges, w2 = merge_edges([g.edges for g in graphs])
    warnings = reduce(DataFrame.unionByName, [*[g.warnings for g in graphs], w1, w2]).dropDuplicates()
    return Graph(nodes, edges, warnings, next(iter(versions), "1"))


def ordered(g: Graph) -> Graph:
    """In the order of emission."""
    return g.with_(nodes=g.nodes.orderBy("id"), edges=g.edges.orderBy("kind", "source_id", "target_id"), warnings=g.warnings.orderBy("code", "message", F.coalesce("location", F.lit("")), F.coalesce("subject_id", F.lit(""))))


def edge_set_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and Jaccard similarity of two edge sets."""
    keys = ["kind", "source_id", "target_id"]
    a = found.select(*keys).distinct().withColumn("a", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("b", F.lit(1))
    n = a.join(b, keys, "full").agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
    return n.select((F.col("both") / F.col("a")).alias("precision"), (F.col("both") / F.col("b")).alias("recall"), (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("jaccard"))
