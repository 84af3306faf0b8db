"""Consumer bundles: a graph, its catalog and some impacts as documents that are checked before they are written."""

from __future__ import annotations

import json
from pathlib import Path

from skeinwork.emit.formats import emit, emit_impact, validate
from skeinwork.functions.selections import impact_selection
from skeinwork.operators.graph import DOWN, UP, impact
from skeinwork.runtime import write_bundle
from skeinwork.schemas import Graph, GraphError


def build_bundle(g: Graph, folder: str, impacts: dict[str, tuple[str, str]], default: str | None = None) -> None:
    """Write ``graph.json``, ``catalog.json``, ``impact-NAME.json`` for each NAME: (selection, direction), and ``bundle.json``; all or none."""
    documents = {"graph.json": emit(g, "json"), "catalog.json": emit(g, "catalog")}
    for name, (selection, direction) in impacts.items():
        documents[f"impact-{name}.json"] = emit_impact(impact(g, impact_selection(selection), UP if direction == "upstream" else DOWN))
    documents["bundle.json"] = json.dumps({"version": "1", "impacts": sorted(impacts), "defaults": {"impact_key": default}}, indent=2, sort_keys=True)
    if problems := bundle_problems(documents):
        raise GraphError("; ".join(problems))
    write_bundle(documents, folder)


def bundle_problems(documents: dict[str, str]) -> list[str]:
    """What is wrong with a bundle's documents; a default impact must be one of the bundle's."""
    out = []
    for name in ("graph.json", "catalog.json"):
        out += [f"{name}: {p}" for p in validate(json.loads(documents.get(name, "{}")))]
    meta = json.loads(documents.get("bundle.json", "{}"))
    default = (meta.get("defaults") or {}).get("impact_key")
    if default is not None and default not in meta.get("impacts", []):
        out.append(f"bundle.json: no impact is named {default}")
    out += [f"bundle.json: impact-{k}.json is missing" for k in meta.get("impacts", []) if f"impact-{k}.json" not in documents]
    return out


def validate_bundle(folder: str) -> list[str]:
    """The problems of a bundle that was built before."""
    return bundle_problems({p.name: p.read_text() for p in Path(folder).glob("*.json")})
