"""Command line: init, scan, compile, impact, clean, contract, query."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from skeinwork.emit.formats import FORMATS, diagnostics, emit, emit_impact
from skeinwork.functions.selections import impact_selection, query_selection
from skeinwork.operators.checks import contract_problems, run_checks
from skeinwork.operators.graph import DOWN, UP, impact
from skeinwork.runtime import execute_contract, register_tables
from skeinwork.schemas import GraphError
from skeinwork.sources.config import FILE, load_project, load_rules
from skeinwork.sources.registry import compile_graph

TEMPLATE = "version: 1\ndialect: ''\nposture: standard\nsources:\n  sql:\n    paths: [models]\n"


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="skeinwork", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "scan", "compile", "impact", "clean", "contract", "query"):
        c = sub.add_parser(name)
        c.add_argument("--project", default=".")
        if name == "compile":
            c.add_argument("--format", default="json", choices=sorted(FORMATS))
        if name in ("compile", "query"):
            c.add_argument("--identity")
        if name == "impact":
            c.add_argument("--format", default="json", choices=("json", "text", "mermaid"))
            c.add_argument("--upstream", action="store_true")
        if name in ("impact", "query"):
            c.add_argument("selection")
        if name == "query":
            c.add_argument("--tables", required=True)
    args = p.parse_args(argv)
    if args.command == "init":
        path = Path(args.project) / FILE
        if path.exists():
            print(f"{path} exists", file=sys.stderr)
            return 1
        path.write_text(TEMPLATE)
        return 0
    spark = spark or SparkSession.builder.appName("skeinwork").getOrCreate()
    try:
        project = load_project(args.project)
        g = compile_graph(spark, project, enforce=args.command not in ("clean", "scan"))
        rules = load_rules(spark, project.rules) if project.rules else None
        if args.command == "compile":
            out.write(emit(g, args.format, args.identity, rules, job=Path(args.project).resolve().name))
            sys.stderr.write(diagnostics(g))
        elif args.command == "scan":
            out.write(emit(g, "text"))
        elif args.command == "impact":
            out.write(emit_impact(impact(g, impact_selection(args.selection), UP if args.upstream else DOWN), args.format))
        elif args.command == "clean":
            for r in run_checks(g, project.posture).orderBy("check_id", "message").collect():
                out.write(f"{r.severity} {r.check_id}: {r.message}\n")
        elif args.command == "contract":
            for r in contract_problems(g).orderBy("id", "problem").collect():
                out.write(f"{r.id}: {r.problem}\n")
        else:
            register_tables(spark, args.tables)
            if rules is None:
                raise GraphError("a query needs policy rules")
            for row in execute_contract(spark, g, rules, args.identity, query_selection(args.selection)).toLocalIterator():
                out.write(str(row.asDict()) + "\n")
    except (GraphError, PermissionError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
