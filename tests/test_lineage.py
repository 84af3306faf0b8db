import json

import pytest

from skeinwork.operators.graph import impact
from skeinwork.plans.parsing import parse, statements
from skeinwork.plans.project import Dataset, compile_project, coverage, coverage_summary, levels, predicate_usage, scoped
from skeinwork.plans.query_map import query_map
from skeinwork.plans.values import Resolver, table_refs
from skeinwork.schemas import GraphError

SCHEMAS = {"stg_a": ["id", "user_id", "amount", "status", "created_at"], "stg_b": ["id", "user_id", "amount", "status", "region"], "stg_users": ["user_id", "email", "country", "created_at"]}
# Statement -> number of value edges.
CASES = {
    "select * from stg_a where amount > 1": 5,
    "select a.*, u.email from stg_a a left join stg_users u on a.user_id = u.user_id": 1,
    "select id, user_id, amount, region from stg_a join stg_b on stg_a.id = stg_b.id": 7,
    "select x.id, y.amount, x.status, y.user_id from stg_a x join stg_a y on x.id = y.user_id": 4,
    "with stg_b as (select id, amount, status from stg_a) select * from stg_b": 3,
    "with base as (select user_id, amount from stg_a), t as (select user_id, sum(amount) as total from base group by user_id) select b.user_id, b.amount, t.total from base b join t on b.user_id = t.user_id": 3,
    "select u.user_id, u.email, (select max(a.amount) from stg_a a where a.user_id = u.user_id) as m from stg_users u": 3,
    "select d.v as w, d.id from (select amount * 2 as v, id from stg_a) d": 2,
    "select amount as a1, amount as a2, case when status = 'x' then user_id else 0 end as c, id from stg_a": 4,
    "select id, row_number() over (partition by user_id order by created_at) as rn, sum(amount) over (partition by user_id) as rs, status from stg_a": 3,
    'select id as "Id", amount as "Amt", status as "S" from stg_a': 3,
    "with c as (select id, amount, status, region from stg_b) select id, amount, status from c": 3,
    "select case when status = 'a' then 1 when region = 'b' then 2 end as f from stg_b": 2,
    "select * from elsewhere": 0,
    "select 1 as one, 'x' as two from stg_a": 0,
}


@pytest.mark.parametrize("sql", CASES)
def test_value_edges(spark, sql):
    r = Resolver(SCHEMAS).resolve(parse(spark, sql))
    assert sum(len(o.refs) for o in r.outputs) == CASES[sql]


def test_unions(spark):
    go = lambda sql: Resolver(SCHEMAS).resolve(parse(spark, sql))
    assert go("select id from stg_a union all select id from stg_b").open_union
    assert not go("select id from stg_a union all select user_id from stg_a").open_union
    stars = go("select * from stg_a union all select * from stg_b")
    assert sorted(stars.column("id").refs) == [("stg_a", "id"), ("stg_b", "id")]
    padded = go("select id, null as email from stg_a union all select user_id, email from stg_users")
    assert padded.column("email").refs == {("stg_users", "email")}


def test_project(spark):
    models = [Dataset("raw", "root", columns=["a", "b"]), Dataset("m1", sql="select a, b as c from raw", dependencies=["raw"]), Dataset("m2", sql="select c, 'x' as k from m1", dependencies=["m1"]), Dataset("bad", sql="select from where", dependencies=["raw"]), Dataset("q", sql='select a as "A" from raw', dependencies=["raw"])]
    g = compile_project(spark, models)
    got = {(r.source_id, r.target_id) for r in g.edges.filter("kind = 'derives_from'").collect()}
    assert got == {("column:m1.a", "column:raw.a"), ("column:m1.c", "column:raw.b"), ("column:m2.c", "column:m1.c")}
    status = {r.name: json.loads(r.aspects["lineage_resolution"])["status"] for r in g.nodes.filter("kind = 'table' and aspects is not null").collect()}
    assert status == {"m1": "complete", "m2": "partial", "bad": "parse_failed", "q": "partial"}
    derived = {r.id: r.derivation.status for r in g.nodes.collect()}
    assert derived["table:m1"] == "complete" and derived["table:bad"] == "failed" and derived["column:m2.k"] == "partial"
    roots = spark.createDataFrame([("table:raw",)], "id string")
    assert coverage_summary(coverage(g, roots)).first().silent == 0
    t = impact(g, "column:raw.b")
    assert {(r.node_id, r.depth) for r in t.related.collect()} == {("column:m1.c", 1), ("column:m2.c", 2)}
    assert t.completeness == "partial"


def test_cycles_levels_and_scopes(spark):
    assert levels({"a": [], "b": ["a"], "c": ["b", "x"], "d": ["e"], "e": ["d"]}) == ([["a"], ["b"], ["c"]], ["d", "e"])
    g = compile_project(spark, [Dataset("a", sql="select x from b", dependencies=["b"]), Dataset("b", sql="select x from a", dependencies=["a"])])
    assert {r.code for r in g.warnings.collect()} == {"dependency_cycle"}
    ds = [Dataset("a"), Dataset("b", dependencies=["a"]), Dataset("c")]
    assert [d.name for d in scoped(ds, ["b"])] == ["a", "b"]
    with pytest.raises(GraphError):
        scoped(ds, ["zz"])


def test_parsing_limits(spark):
    assert statements("select ';' as a; select 2 -- ;\n") == ["select ';' as a", "select 2 -- ;"]
    for bad in ("", "select 1; select 2", "select from"):
        with pytest.raises(GraphError):
            parse(spark, bad)
    assert table_refs(parse(spark, "with c as (select * from x.y) select * from c join z on true")) == ["x.y", "z"]
    assert parse(spark, "select a::number from t", "snowflake").kind == "Project"
    tree = parse(spark, "select a from t join u on t.k = u.k where b > 1 group by a, c order by d")
    assert [predicate_usage(tree, c) for c in "kbcdz"] == ["join", "filter", "grouping", "ordering", None]


def test_query_map(spark):
    m = query_map(spark, "with c as (select * from a) select c.x from c join b on c.k > b.k union select 1 from d")
    assert m.relations == {"cte:c": "cte", "table:a": "table", "table:b": "table", "table:d": "table"}
    assert ("query:root", "table:b", "join") in m.usages and ("cte:c", "table:a", "cte_body") in m.usages
    assert {w[0] for w in m.warnings} == {"unsupported_construct", "select_star", "non_equi_join"}
    with pytest.raises(GraphError):
        query_map(spark, "drop table x")
    assert set(m.frames(spark)) == {"relations", "usages", "edges", "warnings"}
