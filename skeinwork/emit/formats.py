"""Formats and their registry.

A format has a lane (``internal`` or ``consumer``), a slice of node kinds, and says whether warnings go.
The consumer lane needs an identity and rules, and passes the policy gate.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.identity import column_selection
from skeinwork.operators.graph import Traversal, edge_kind_counts, mermaid, select_kinds
from skeinwork.operators.merge import ordered
from skeinwork.operators.policy import apply_policy, gated_identity
from skeinwork.schemas import Graph, GraphError

NAMESPACE = "skeinwork"
TABLE_KINDS = ("table", "column", "model")
CONTRACT_KINDS = ("metric", "query", "report", "page", "visual")


@dataclass(frozen=True)
class Format:
    name: str
    lane: str
    kinds: tuple[str, ...] | None
    clear_warnings: bool
    render: Callable[[Graph, dict], str]


def graph_rows(g: Graph) -> DataFrame:
    """(section, value): a JSON document per node, edge and warning, nulls left out. Fit for a distributed write of any size."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("value")) for name, df in (("nodes", g.nodes), ("edges", g.edges), ("warnings", g.warnings))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def graph_dict(g: Graph) -> dict:
    """The whole graph on the driver, in order: for graphs of the size of a project."""
    o = ordered(g)
    out: dict = {"version": g.version}
    for name, df in (("nodes", o.nodes), ("edges", o.edges), ("warnings", o.warnings)):
        out[name] = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()]
    for n in out["nodes"]:
        if "aspects" in n:
            n["aspects"] = {k: _loads(v) for k, v in sorted(n["aspects"].items())}
    return out


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def _dump(x: dict) -> str:
    return json.dumps(x, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def as_json(g: Graph, _options: dict) -> str:
    return _dump(graph_dict(g))


def as_text(g: Graph, _options: dict) -> str:
    kinds = g.nodes.groupBy("kind").count().orderBy("kind").collect()
    lines = [f"nodes: {sum(r['count'] for r in kinds)}", *[f"  {r.kind}: {r['count']}" for r in kinds]]
    edges = edge_kind_counts(g).orderBy("kind").collect()
    lines += [f"edges: {sum(r.n for r in edges)}", *[f"  {r.kind}: {r.n}" for r in edges]]
    warnings = g.warnings.orderBy("code", "message").collect()
    lines += [f"warnings: {len(warnings)}", *[f"  {w.code}: {w.message}" for w in warnings]]
    return "\n".join(lines) + "\n"


def openlineage_fields(g: Graph) -> DataFrame:
    """(dataset, column, inputs): for every output column its distinct input fields, sorted."""
    out, source = column_selection(F.col("source_id")), column_selection(F.col("target_id"))
    pairs = g.edges.filter("kind = 'derives_from'").select(out["dataset"].alias("dataset"), out["column"].alias("column"), F.struct(source["dataset"].alias("name"), source["column"].alias("field")).alias("input"))
    return pairs.groupBy("dataset", "column").agg(F.array_sort(F.collect_set("input")).alias("inputs"))


def as_openlineage(g: Graph, options: dict) -> str:
    outputs: dict[str, dict] = {}
    for r in openlineage_fields(g).orderBy("dataset", "column").collect():
        fields = outputs.setdefault(r.dataset, {})
        fields[r.column] = {"inputFields": [{"namespace": NAMESPACE, "name": i.name, "field": i.field} for i in r.inputs]}
    inputs = sorted({f["name"] for d in outputs.values() for c in d.values() for f in c["inputFields"]})
    return _dump({
        "job": {"namespace": NAMESPACE, "name": options.get("job", "project")},
        "inputs": [{"namespace": NAMESPACE, "name": n} for n in inputs],
        "outputs": [{"namespace": NAMESPACE, "name": n, "facets": {"columnLineage": {"fields": f}}} for n, f in outputs.items()],
    })


def envelope(name: str, identity: str, payload: dict) -> dict:
    return {"format": name, "version": "1", "identity": identity, "node_count": len(payload["nodes"]), "edge_count": len(payload["edges"]), "payload": payload}


def _consumer(name: str) -> Callable[[Graph, dict], str]:
    return lambda g, options: _dump(envelope(name, options["identity"], graph_dict(g)))


FORMATS = {
    f.name: f
    for f in (
        Format("json", "internal", None, False, as_json),
        Format("text", "internal", None, False, as_text),
        Format("catalog", "internal", TABLE_KINDS, True, as_json),
        Format("openlineage", "internal", None, False, as_openlineage),
        Format("consumer-catalog", "consumer", TABLE_KINDS, True, _consumer("consumer-catalog")),
        Format("frontend-contract", "consumer", CONTRACT_KINDS, True, _consumer("frontend-contract")),
        Format("ai-context", "consumer", (*TABLE_KINDS, *CONTRACT_KINDS), True, _consumer("ai-context")),
    )
}


def emit(g: Graph, name: str, identity: str | None = None, rules: DataFrame | None = None, **options) -> str:
    """A graph in a format; the consumer lane raises without identity and rules."""
    if name not in FORMATS:
        raise GraphError(f"unknown format: {name!r}; known: {', '.join(FORMATS)}")
    f = FORMATS[name]
    if f.kinds:
        g = select_kinds(g, *f.kinds, clear_warnings=f.clear_warnings)
    if f.lane == "consumer":
        if rules is None:
            raise GraphError(f"{name} needs policy rules")
        options["identity"] = gated_identity(identity)
        g = apply_policy(g, rules, identity)
    return f.render(g, options)


def emit_impact(t: Traversal, name: str = "json") -> str:
    """A traversal as json, text or mermaid."""
    related = [r.node_id for r in t.related.orderBy("depth", "node_id").collect()]
    edges = [(r.source_id, r.target_id) for r in t.edges.orderBy("source_id", "target_id").collect()]
    if name == "mermaid":
        return mermaid(edges)
    warnings = [{k: v for k, v in w.asDict().items() if v is not None} for w in t.warnings.orderBy("code", "message").collect()]
    if name == "text":
        return "\n".join([f"{t.direction} of {t.selection_id}: {len(related)}", *[f"  {r}" for r in related], *[f"warning {w['code']}: {w['message']}" for w in warnings]]) + "\n"
    if name != "json":
        raise GraphError(f"unknown format: {name!r}")
    return _dump({
        "selection_id": t.selection_id, "direction": t.direction, "related_ids": related, "traversed_edges": [{"source_id": a, "target_id": b} for a, b in edges], "warnings": warnings,
        "resolver_completeness": t.completeness, "unknown_edges_possible": t.unknown_edges_possible, "blocking_findings": list(t.blocking_findings),
    })


def diagnostics(g: Graph) -> str:
    """A note when a graph has no column lineage; else empty."""
    if not g.edges.filter("kind = 'derives_from'").isEmpty():
        return ""
    codes = g.warnings.groupBy("code").count().orderBy("code").collect()
    return "\n".join(["no column lineage was found", *[f"  {r.code}: {r['count']}" for r in codes]]) + "\n"


def validate(doc: dict) -> list[str]:
    """Problems of a graph document: unknown or missing keys, wrong kinds, wrong versions."""
    nodes, edges = {"id", "kind", "name", "qualified_name", "schema", "evidence", "derivation", "bindings", "aspects"}, {"kind", "source_id", "target_id", "label", "confidence", "match_status", "evidence", "derivation"}
    from skeinwork.schemas import EDGE_KINDS, NODE_KINDS

    out = [f"unknown key {k}" for k in sorted(set(doc) - {"version", "nodes", "edges", "warnings"})]
    if doc.get("version") != "1":
        out.append("version must be 1")
    for name, known, needed, kinds in (("nodes", nodes, ("id", "kind", "name"), NODE_KINDS), ("edges", edges, ("kind", "source_id", "target_id"), EDGE_KINDS)):
        for i, row in enumerate(doc.get(name) or []):
            out += [f"{name}[{i}] has the unknown key {k}" for k in sorted(set(row) - known)]
            out += [f"{name}[{i}] lacks {k}" for k in needed if not row.get(k)]
            if row.get("kind") not in kinds:
                out.append(f"{name}[{i}] has the unknown kind {row.get('kind')!r}")
    return out
