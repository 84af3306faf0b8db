import io
import json

import pytest
from pyspark.sql import functions as F

from skeinwork import cli
from skeinwork.operators.match import attach_bindings
from skeinwork.runtime import execute, execute_contract, write_bundle
from skeinwork.schemas import GraphError, graph_of
from skeinwork.sources import models, powerbi, warehouse
from skeinwork.sources.config import FILE, load_project, load_rules, read_aliases
from skeinwork.sources.registry import compile_graph
from skeinwork.streaming import incremental

EXPORT = {"warehouse": "w", "tables": [{"database": "db", "schema": "s", "name": "Orders", "columns": [{"name": "id", "data_type": "bigint", "nullable": False, "ordinal_position": 1}, {"name": "total", "data_type": "geometry"}]}]}


@pytest.fixture
def project(tmp_path):
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "rep.sql").write_text("select o.id, o.total as amount from orders o")
    (tmp_path / "models" / "top.sql").write_text("select amount from rep")
    (tmp_path / "wh.json").write_text(json.dumps(EXPORT))
    (tmp_path / "intent.yaml").write_text("metrics:\n- {id: m, name: M, formula: sum(amount), depends_on: ['column:rep.amount']}\nqueries:\n- {id: q, name: Q, sql: 'select count(*) as n from one', depends_on: ['metric:m']}\n")
    (tmp_path / "rules.yaml").write_text("rules:\n- {id: r, kind: rbac, identity: me}\n")
    (tmp_path / FILE).write_text("version: 1\nsources:\n  warehouse: {kind: export, path: wh.json}\n  sql: {paths: [models]}\n  intent: {paths: [intent.yaml]}\npolicy: {rules: rules.yaml}\n")
    return tmp_path


def test_compile_project_folder(spark, project, capsys):
    p = load_project(str(project))
    assert p.kinds == ["warehouse", "sql", "intent"]
    g = compile_graph(spark, p)
    kinds = {r.kind: r["count"] for r in g.nodes.groupBy("kind").count().collect()}
    assert kinds["metric"] == kinds["query"] == 1
    bound = {r.id: r.b for r in g.nodes.filter("kind = 'column'").select("id", F.get("bindings", F.lit(0))["table"].alias("b")).collect()}
    assert bound["column:orders.id"] == "Orders" and bound["column:db.s.orders.id"] is None
    deps = {(r.source_id, r.target_id) for r in g.edges.filter("kind = 'depends_on'").collect()}
    assert {("column:rep.amount", "metric:m"), ("metric:m", "query:q"), ("table:top", "table:rep")} <= deps
    spark.range(3).createOrReplaceTempView("one")
    assert execute_contract(spark, g, load_rules(spark, p.rules), "me", "query:q").first().n == 3
    with pytest.raises(PermissionError):
        execute_contract(spark, g, load_rules(spark, p.rules), "you", "query:q")
    assert cli.main(["compile", "--format", "ai-context", "--project", str(project)], spark) == 1


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["init", "--project", str(tmp_path)]) == 0 and cli.main(["init", "--project", str(tmp_path)]) == 1
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "a.sql").write_text("select 1 as one")
    (tmp_path / "models" / "b.sql").write_text("select one from a")
    out = io.StringIO()
    assert cli.main(["impact", "column:a.one", "--format", "text", "--project", str(tmp_path)], spark, out) == 0
    assert "column:b.one" in out.getvalue()


def test_config_errors(tmp_path):
    for text in ("version: 2\nsources: {sql: {paths: []}}", "version: 1", "version: 1\nsources: {sql: {paths: [../x]}}", "version: 1\nsources: {warehouse: {path: a, query: b}}", "version: 1\nposture: x\nsources: {sql: {}}", "version: 1\nextra: 1\nsources: {sql: {}}"):
        (tmp_path / FILE).write_text(text)
        with pytest.raises(GraphError):
            load_project(str(tmp_path))
    a = tmp_path / "aliases.yaml"
    a.write_text("version: 1\ntable_aliases:\n  A.B: c\n  a.b: C\n")
    assert read_aliases(a) == {"a.b": "c"}
    a.write_text("version: 1\ntable_aliases:\n  a: b\n  A: c\n")
    with pytest.raises(GraphError):
        read_aliases(a)


def test_warehouse(spark, tmp_path):
    path = tmp_path / "wh.json"
    path.write_text(json.dumps(EXPORT))
    tables = warehouse.read_export(spark, str(path))
    g = warehouse.warehouse_graph(tables)
    assert {r.id for r in g.nodes.collect()} == {"table:db.s.orders", "column:db.s.orders.id", "column:db.s.orders.total"}
    assert g.edges.count() == 0
    typed, warnings = warehouse.column_types(tables)
    assert [(r["column"], r.type) for r in typed.collect()] == [("id", "bigint")]
    assert warnings.first().code == "unsupported_column_type"
    other = spark.createDataFrame([("db.s.orders", "id", "int")], "dataset string, column string, type string")
    best, conflicts = warehouse.resolve_types(typed, other, other.limit(0))
    assert best.first().type == "bigint" and conflicts.count() == 1
    nodes = spark.createDataFrame([("table:orders", "table", "orders", "orders"), ("column:orders.zz", "column", "zz", "orders.zz"), ("table:x", "table", "x", None)], "id string, kind string, name string, qualified_name string")
    out = attach_bindings(graph_of(spark, nodes), g)
    assert {r.subject_id for r in out.warnings.collect()} == {"column:orders.zz", "table:x"}


def test_manifest(spark, tmp_path):
    doc = {
        "nodes": {
            "model.p.a": {"resource_type": "model", "name": "a", "schema": "s", "compiled_code": "select id from src", "depends_on": {"nodes": ["source.p.raw.src"]}, "columns": {"id": {"name": "id", "data_type": "int"}}},
            "model.p.b": {"resource_type": "model", "name": "b", "compiled_path": "b.sql", "depends_on": {"nodes": ["model.p.a"]}, "columns": {}},
            "test.p.t": {"resource_type": "test", "name": "t"},
        },
        "sources": {"source.p.raw.src": {"resource_type": "source", "name": "src", "columns": {"id": {"name": "id"}}}},
    }
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(doc))
    (tmp_path / "b.sql").write_text("select id from s.a")
    found = {d.name: d for d in models.load(spark, str(path))}
    assert set(found) == {"s.a", "b", "src"} and found["b"].dependencies == ["s.a"] and found["src"].kind == "root"
    doc["nodes"]["model.p.b"]["compiled_path"] = "../b.sql"
    path.write_text(json.dumps(doc))
    with pytest.raises(GraphError):
        models.load(spark, str(path))
    doc["nodes"]["model.p.b"] |= {"compiled_code": "select 1", "depends_on": {"nodes": ["model.p.zz"]}}
    path.write_text(json.dumps(doc))
    with pytest.raises(GraphError):
        models.load(spark, str(path))
    with pytest.raises(GraphError):
        models.load(spark, str(tmp_path / "other.json"))


def test_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "A.sql").write_text("select 1 as one")
    (tmp_path / "b.sql").write_text("select one from x.a")
    assert {d.name: d.dependencies for d in models.load(spark, str(tmp_path))} == {"x.a": [], "b": ["x.a"]}
    (tmp_path / "c.sql").write_text(" ")
    with pytest.raises(GraphError):
        models.load(spark, str(tmp_path))
    with pytest.raises(GraphError):
        models.overlay([], {"t": {"c": " "}})
    assert models.overlay([], {"t": {"C": "int"}})[0].columns == ["c"]


def test_execute_errors(spark, tmp_path):
    assert execute(spark, "select :x as v", {"x": 2}).first().v == 2
    with pytest.raises(GraphError):
        execute(spark, "select * from nowhere_at_all").collect()
    write_bundle({"a.json": "{}"}, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.json").read_text() == "{}"


M = 'let Source = Sql.Database("srv", "Db"), Nav = Source{[Schema="dbo",Item="Sales"]}[Data], T = Table.Buffer(Nav) in T'


def test_powerbi(spark, tmp_path):
    assert [(s.database, s.schema, s.item) for s in powerbi.m_sources(M)] == [("Db", "dbo", "Sales")]
    assert powerbi.m_sources("let a = b, b = a in a") == []
    native = powerbi.m_sources('Value.NativeQuery(Sql.Database("s","d"), "select * from dbo.Orders o join x on 1=1")')
    assert powerbi.native_tables(native[0].native_sql) == [("dbo", "orders"), (None, "x")]
    model = tmp_path / "p.SemanticModel" / "definition" / "tables"
    model.mkdir(parents=True)
    (model / "Sales.tmdl").write_text("table Sales\n\n\tpartition Sales = m\n\t\tmode: import\n\t\tsource =\n\t\t\t\t" + M.replace(", Nav", ",\n\t\t\t\tNav") + "\n")
    visual = tmp_path / "p.Report" / "definition" / "pages" / "one" / "visuals" / "v1"
    visual.mkdir(parents=True)
    (visual / "visual.json").write_text(json.dumps({"name": "v1", "query": {"From": [{"Name": "s", "Entity": "Sales"}], "x": [{"Column": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "amount"}}, {"Measure": {"Expression": {"SourceRef": {"Entity": "Sales"}}, "Property": "m"}}]}}))
    (tmp_path / "p.pbip").write_text(json.dumps({"artifacts": [{"report": {"path": "p.Report"}}]}))
    g = powerbi.bi_graph(spark, str(tmp_path))
    assert {r.source_id for r in g.edges.filter("kind = 'feeds'").collect()} == {"table:db.dbo.sales"}
    assert {r.code for r in g.warnings.collect()} == {"dax_deferred"}
    export = spark.createDataFrame([("w", "x", "dbo", "sales", [])], "warehouse string, database string, schema string, table string, columns array<struct<name:string,data_type:string,nullable:boolean,ordinal_position:int,comment:string>>")
    both = powerbi.merge_with_warehouse(g, warehouse.warehouse_graph(export))
    feeds = both.edges.filter("kind = 'feeds'").first()
    assert (feeds.source_id, feeds.match_status) == ("table:x.dbo.sales", "resolved")


def test_stream_merges_batches(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    line = lambda section, **v: json.dumps({"section": section, "value": json.dumps(v)})
    (folder / "1.json").write_text(line("nodes", id="a", kind="table", name="x") + "\n" + line("edges", kind="feeds", source_id="a", target_id="a") + "\n")
    incremental.start(incremental.document_stream(spark, str(folder)), store, str(tmp_path / "cp")).awaitTermination()
    (folder / "2.json").write_text(line("nodes", id="a", kind="table", name="y") + "\n")
    incremental.start(incremental.document_stream(spark, str(folder)), store, str(tmp_path / "cp")).awaitTermination()
    g = incremental.read_version(spark, store, 1)
    assert [(r.id, r.name) for r in g.nodes.collect()] == [("a", "x")] and g.edges.count() == 1
    assert [r.code for r in g.warnings.collect()] == ["source_disagreement"]
