"""The structure of a single statement: relations, how they are used, dependencies, and constructs that are flagged."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from skeinwork.plans.parsing import Tree, parse
from skeinwork.schemas import GraphError

ALLOWED = ("UnresolvedWith", "Project", "Aggregate", "Filter", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "WithWindowDefinition", "InsertIntoStatement", "CreateTableAsSelect", "SubqueryAlias")


@dataclass
class QueryMap:
    relations: dict[str, str] = field(default_factory=dict)  # id -> kind
    usages: list[tuple[str, str, str]] = field(default_factory=list)  # scope, relation, from | join | cte_body
    edges: list[tuple[str, str]] = field(default_factory=list)  # scope -> relation
    warnings: list[tuple[str, str]] = field(default_factory=list)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "relations": spark.createDataFrame(sorted(self.relations.items()), "id string, kind string"),
            "usages": spark.createDataFrame(self.usages, "scope string, relation string, usage string"),
            "edges": spark.createDataFrame(self.edges, "source_id string, target_id string"),
            "warnings": spark.createDataFrame(self.warnings, "code string, message string"),
        }


def query_map(spark: SparkSession, sql: str, dialect: str = "") -> QueryMap:
    """A map of a SELECT, INSERT ... SELECT or CREATE TABLE AS; other statements raise. A table expression's name shadows a table's."""
    tree = parse(spark, sql, dialect)
    if tree.kind not in ALLOWED:
        raise GraphError(f"only a query can be mapped, not {tree.kind}")
    out = QueryMap()
    _scope(tree, "query:root", {}, out)
    _flag(tree, out)
    out.usages = list(dict.fromkeys(out.usages))
    out.edges = list(dict.fromkeys(out.edges))
    return out


def _scope(t: Tree, scope: str, ctes: dict[str, str], out: QueryMap, usage: str = "from") -> None:
    if t.kind == "UnresolvedWith":
        ctes = dict(ctes)
        for c in t.parts["ctes"]:
            id_ = f"cte:{c.parts['name'].lower()}"
            out.relations[id_] = "cte"
            if t.parts["recursive"]:
                ctes[c.parts["name"].lower()] = id_
            _scope(c.children[0], id_, ctes, out, "cte_body")
            ctes[c.parts["name"].lower()] = id_
        _scope(t.children[0], scope, ctes, out, usage)
        return
    if t.kind == "UnresolvedRelation":
        name = t.parts["name"].lower()
        id_ = ctes.get(name, f"table:{name}")
        out.relations.setdefault(id_, id_.partition(":")[0])
        out.usages.append((scope, id_, usage))
        out.edges.append((scope, id_))
        return
    if t.kind in ("Join", "LateralJoin"):
        _scope(t.children[0], scope, ctes, out, usage)
        for c in t.children[1:]:
            _scope(c, scope, ctes, out, "join")
        return
    for c in t.every():
        _scope(c, scope, ctes, out, usage)


def _equal_only(e: Tree) -> bool:
    if e.kind == "And":
        return all(map(_equal_only, e.children))
    return e.kind == "EqualTo"


def _flag(tree: Tree, out: QueryMap) -> None:
    seen = set()
    for t in tree.walk():
        if t.kind in ("Union", "Intersect", "Except") and t.kind not in seen:
            seen.add(t.kind)
            out.warnings.append(("unsupported_construct", f"{t.kind.upper()} is not mapped"))
        elif t.kind == "UnresolvedStar":
            target = t.parts["target"]
            out.warnings.append(("table_star", f"{target}.* hides its columns") if target else ("select_star", "* hides its columns"))
        elif t.kind == "Join" and not t.parts["using"]:
            if "condition" not in t.parts:
                out.warnings.append(("join_without_condition", "a join has neither ON nor USING"))
            elif not _equal_only(t.parts["condition"]):
                out.warnings.append(("non_equi_join", "a join's condition isn't a conjunction of equalities"))
        elif t.kind == "UnresolvedWith" and t.parts["recursive"]:
            out.warnings.append(("recursive_cte", "a recursive table expression is not followed"))
