"""The project file, and small YAML inputs: aliases, policy rules, intent."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from skeinwork.functions.selections import normal
from skeinwork.schemas import NODES, POSTURES, RULES, Graph, GraphError, graph_of, struct

# Fixed values of the project file.
FILE = "skeinwork.yaml"
TOP_KEYS = {"version", "dialect", "sources", "posture", "policy", "aliases", "name"}
SOURCE_KEYS = {"warehouse", "dbt", "sql", "intent"}
RUNTIME_KEYS = {"execute", "query", "runtime", "connection_string"}
RULE_KINDS = ("rbac", "rls", "masking", "ai_permission", "export")
RULE_EFFECTS = ("allow", "deny", "mask")


@dataclass(frozen=True)
class Project:
    root: Path
    dialect: str = ""
    posture: str = "standard"
    warehouse: Path | None = None
    dbt: Path | None = None
    sql: tuple[Path, ...] = ()
    intent: tuple[Path, ...] = ()
    rules: Path | None = None
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def kinds(self) -> list[str]:
        """The sources it has, in the order of ingestion."""
        return [k for k in ("warehouse", "dbt", "sql", "intent") if getattr(self, k)]


def _inside(root: Path, value: str, what: str) -> Path:
    path = (root / value).resolve()
    if not path.is_relative_to(root.resolve()):
        raise GraphError(f"{what} leaves the project folder: {value}")
    if not path.exists():
        raise GraphError(f"{what} doesn't exist: {value}")
    return path


def _yaml(path: Path) -> dict:
    try:
        found = yaml.safe_load(path.read_text()) or {}
    except yaml.YAMLError as e:
        raise GraphError(f"can't read {path.name}: {e}") from e
    if not isinstance(found, dict):
        raise GraphError(f"{path.name} isn't a mapping")
    return found


def load_project(folder: str) -> Project:
    """Read and check a project file; paths are relative to it, stay inside it and must exist; one source at least."""
    root = Path(folder)
    path = root / FILE
    if not path.is_file():
        raise GraphError(f"no {FILE} in {folder}")
    raw = _yaml(path)
    if extra := sorted(set(raw) - TOP_KEYS):
        raise GraphError(f"unknown keys: {', '.join(extra)}")
    if raw.get("version") != 1:
        raise GraphError("version must be 1")
    posture = raw.get("posture", "standard")
    if posture not in POSTURES:
        raise GraphError(f"unknown posture: {posture!r}")
    sources = raw.get("sources") or {}
    if extra := sorted(set(sources) - SOURCE_KEYS):
        raise GraphError(f"unknown sources: {', '.join(extra)}")
    warehouse = sources.get("warehouse") or {}
    if banned := sorted(set(warehouse) & RUNTIME_KEYS):
        raise GraphError(f"sources.warehouse can't hold {', '.join(banned)}")
    if not sources:
        raise GraphError("a project needs a source")
    aliases = read_aliases(_inside(root, raw["aliases"], "aliases")) if raw.get("aliases") else {}
    rules = (raw.get("policy") or {}).get("rules")
    project = Project(
        root,
        raw.get("dialect", ""),
        posture,
        _inside(root, warehouse["path"], "warehouse") if warehouse else None,
        _inside(root, sources["dbt"]["manifest"], "manifest") if sources.get("dbt") else None,
        tuple(_inside(root, p, "sql path") for p in (sources.get("sql") or {}).get("paths", [])),
        tuple(_inside(root, p, "intent path") for p in (sources.get("intent") or {}).get("paths", [])),
        _inside(root, rules, "policy rules") if rules else None,
        aliases,
    )
    if project.rules:
        rule_rows(project.rules)
    return project


def read_aliases(path: Path) -> dict[str, str]:
    """``version: 1`` and ``table_aliases:`` pairs, a line each; both sides normalised; a name with two targets raises."""
    out: dict[str, str] = {}
    lines = [line.split("#")[0].rstrip() for line in path.read_text().splitlines()]
    lines = [line for line in lines if line.strip()]
    if not lines or lines[0].replace(" ", "") != "version:1":
        raise GraphError("an alias file starts with version: 1")
    if len(lines) < 2 or lines[1].strip() != "table_aliases:":
        raise GraphError("an alias file has table_aliases:")
    for line in lines[2:]:
        m = re.fullmatch(r"\s+(\S+?)\s*:\s*(\S+)\s*", line)
        if not m:
            raise GraphError(f"not an alias: {line!r}")
        name, target = normal(m[1].strip("'\"")), normal(m[2].strip("'\""))
        if out.setdefault(name, target) != target:
            raise GraphError(f"alias {name} has two targets")
    return out


def alias_frame(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(aliases.items()), "alias string, target string")


def rule_rows(path: Path) -> list[tuple]:
    rows = []
    for rule in _yaml(path).get("rules") or []:
        if not isinstance(rule, dict) or not all(rule.get(k) for k in ("id", "kind", "identity")):
            raise GraphError(f"a rule needs id, kind and identity: {rule!r}")
        effect = rule.get("effect", "allow")
        if rule["kind"] not in RULE_KINDS or effect not in RULE_EFFECTS:
            raise GraphError(f"unknown kind or effect in rule {rule['id']}")
        rows.append((rule["id"], rule["kind"], rule["identity"], effect, (rule.get("selector") or {}).get("kind")))
    return rows


def load_rules(spark: SparkSession, path: Path | None) -> DataFrame:
    """Policy rules as rows; no file means no rules."""
    return spark.createDataFrame(rule_rows(path) if path else [], struct(RULES))


def load_intent(spark: SparkSession, paths: tuple[Path, ...]) -> Graph:
    """``metrics`` and ``queries`` of YAML files as nodes; raises once with all their errors."""
    rows, errors = [], []
    for path in sorted(f for p in paths for f in (p.rglob("*.y*ml") if p.is_dir() else [p])):
        raw = _yaml(path)
        for kind, key, body, fields in (("metric", "metrics", "formula", ("formula", "unit", "description", "depends_on")), ("query", "queries", "sql", ("sql", "parameters", "description", "depends_on"))):
            for item in raw.get(key) or []:
                lost = [k for k in ("id", "name", body) if not str(item.get(k) or "").strip()]
                if lost:
                    errors.append(f"{path.name}: a {kind} lacks {', '.join(lost)}")
                    continue
                aspect = {k: item[k] for k in fields if item.get(k) is not None}
                rows.append((f"{kind}:{normal(str(item['id']))}", kind, item["name"], str(item["id"]), {kind: json.dumps(aspect, sort_keys=True)}))
    if errors:
        raise GraphError("; ".join(errors))
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, aspects map<string,string>")
    return graph_of(spark, nodes)


__all__ = ["NODES", "Project", "alias_frame", "load_intent", "load_project", "load_rules", "read_aliases"]
