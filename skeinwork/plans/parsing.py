"""Parsed plans of the session's SQL parser, as small Python trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from skeinwork.schemas import GraphError

# Conf that makes the parser read ANSI SQL with quoted identifiers.
PARSER = {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.enforceReservedKeywords": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true"}
# Type names of other dialects -> ours.
SHIMS = {"snowflake": {"number": "decimal", "variant": "string"}, "bigquery": {"int64": "bigint", "float64": "double"}, "": {}}


@dataclass
class Tree:
    """A node of a plan or an expression: its kind, its parts, and the text it came from."""

    kind: str
    parts: dict[str, Any] = field(default_factory=dict)
    children: list["Tree"] = field(default_factory=list)
    text: str = ""

    def walk(self) -> Iterator["Tree"]:
        todo = [self]
        while todo:
            at = todo.pop()
            yield at
            todo += reversed(at.every())

    def every(self) -> list["Tree"]:
        parts = [v for value in self.parts.values() for v in (value if isinstance(value, list) else [value]) if isinstance(v, Tree)]
        return parts + self.children


@contextmanager
def parser_conf(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in PARSER}
    for k, v in PARSER.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _seq(x: Any) -> list:
    return [x.apply(i) for i in range(x.size())]


def _option(x: Any) -> Any:
    return x.get() if x.isDefined() else None


def statements(sql: str) -> list[str]:
    """The statements of a text, split at semicolons outside quotes and comments."""
    pieces = re.split(r"""('(?:[^'\\]|''|\\.)*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/)""", sql, flags=re.S)
    joined = "".join(p.replace(";", "\0") if i % 2 == 0 else p for i, p in enumerate(pieces))
    return [s for s in (p.strip() for p in joined.split("\0")) if re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()]


def parse(spark: SparkSession, sql: str, dialect: str = "") -> Tree:
    """The tree of one statement; an empty, broken or second statement raises."""
    found = statements(sql or "")
    if not found:
        raise GraphError("empty SQL")
    if len(found) > 1:
        raise GraphError("more than one statement")
    text = found[0]
    for name, ours in SHIMS.get(dialect, {}).items():
        text = re.sub(rf"(?i)(::\s*|\bas\s+){name}\b", lambda m, o=ours: m[1] + o, text)
    with parser_conf(spark):
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
            return _plan(plan, text)
        except (Py4JJavaError, PySparkException) as e:
            raise GraphError(f"can't parse: {' '.join(str(e).split())[:200]}") from e


def _name(x: Any) -> str:
    return x.getClass().getSimpleName()


def _plan(p: Any, sql: str) -> Tree:
    kind = _name(p)
    t = Tree(kind)
    if kind == "UnresolvedWith":
        t.parts["ctes"] = []
        for pair in _seq(p.cteRelations()):
            t.parts["ctes"].append(Tree("Cte", {"name": pair._1()}, [_plan(pair._2().child(), sql)]))
        t.parts["recursive"] = bool(p.allowRecursion())
        t.children = [_plan(p.child(), sql)]
        return t
    if kind == "UnresolvedRelation":
        t.parts["name"] = ".".join(_seq(p.multipartIdentifier()))
        return t
    if kind == "SubqueryAlias":
        t.parts["alias"] = p.alias()
    elif kind == "UnresolvedSubqueryColumnAliases":
        t.parts["names"] = _seq(p.outputColumnNames())
    elif kind == "Project":
        t.parts["items"] = [_expr(e, sql) for e in _seq(p.projectList())]
    elif kind == "Aggregate":
        t.parts["items"] = [_expr(e, sql) for e in _seq(p.aggregateExpressions())]
        t.parts["grouping"] = [_expr(e, sql) for e in _seq(p.groupingExpressions())]
    elif kind in ("Filter", "UnresolvedHaving"):
        t.parts["condition"] = _expr(p.condition() if kind == "Filter" else p.havingCondition(), sql)
    elif kind == "Sort":
        t.parts["order"] = [_expr(e, sql) for e in _seq(p.order())]
    elif kind == "Join":
        t.parts["how"] = p.joinType().toString()
        condition = _option(p.condition())
        t.parts["using"] = t.parts["how"].startswith("Using")
        if condition is not None:
            t.parts["condition"] = _expr(condition, sql)
    elif kind == "LateralJoin":
        t.children = [_plan(p.left(), sql), _plan(p.right().plan(), sql)]
        return t
    elif kind in ("InsertIntoStatement", "CreateTableAsSelect"):
        t.children = [_plan(p.query(), sql)]
        return t
    t.children = [_plan(c, sql) for c in _seq(p.children())]
    return t


def _expr(e: Any, sql: str) -> Tree:
    kind = _name(e)
    origin = e.origin()
    begin, end = _option(origin.startIndex()), _option(origin.stopIndex())
    t = Tree(kind, text=sql[begin : end + 1] if begin is not None and end is not None else "")
    if kind == "UnresolvedAttribute":
        t.parts["names"] = _seq(e.nameParts())
        return t
    if kind == "UnresolvedStar":
        target = _option(e.target())
        t.parts["target"] = ".".join(_seq(target)) if target is not None else None
        return t
    if kind == "Alias":
        t.parts["name"] = e.name()
    elif kind == "Literal":
        t.parts["null"] = e.value() is None
        return t
    elif kind == "UnresolvedFunction":
        t.parts["function"] = ".".join(_seq(e.nameParts())).lower()
        t.children = [_expr(c, sql) for c in _seq(e.arguments())]
        where = _option(e.filter())
        if where is not None:
            t.parts["filter"] = _expr(where, sql)
        return t
    elif kind == "CaseWhen":
        branches = _seq(e.branches())
        t.parts["conditions"] = [_expr(b._1(), sql) for b in branches]
        other = _option(e.elseValue())
        t.parts["arms"] = [_expr(b._2(), sql) for b in branches] + ([_expr(other, sql)] if other is not None else [])
        return t
    elif kind in ("WindowExpression", "UnresolvedWindowExpression"):
        t.children = [_expr(e.windowFunction() if kind == "WindowExpression" else e.child(), sql)]
        if kind == "WindowExpression":
            t.parts["window"] = [_expr(c, sql) for c in _seq(e.windowSpec().children())]
        return t
    elif kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery"):
        if kind == "InSubquery":
            t.children = [_expr(c, sql) for c in _seq(e.values())]
            t.parts["plan"] = _plan(e.query().plan(), sql)
        else:
            t.parts["plan"] = _plan(e.plan(), sql)
        return t
    t.children = [_expr(c, sql) for c in _seq(e.children())]
    return t
