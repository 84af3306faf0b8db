import random

import pytest
from pyspark.sql import functions as F

from skeinwork.catalog import data_graph
from skeinwork.emit.formats import emit, emit_impact, graph_dict, graph_rows, validate
from skeinwork.operators import checks, graph, match, merge, policy
from skeinwork.schemas import GraphError, graph_of


def nodes(spark, rows, columns="id string, kind string, name string"):
    return spark.createDataFrame(rows, columns)


def edges(spark, pairs, kind="derives_from"):
    return spark.createDataFrame([(kind, a, b) for a, b in pairs], "kind string, source_id string, target_id string")


def reference_reach(pairs, start):
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    depth, at, out = 0, {start}, {}
    while at:
        depth += 1
        at = {y for x in at for y in ahead.get(x, ())} - set(out)
        out |= {x: depth for x in at}
    return out


def test_reach_on_random_graphs(spark):
    rng = random.Random(1)
    for _ in range(3):
        pairs = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)]
        seeds = ["n0", "n1"]
        e = edges(spark, pairs)
        got = graph.reach(graph.adjacency(e, graph.UP), spark.createDataFrame([(s,) for s in seeds], "node_id string"))
        assert {(r.seed, r.node_id, r.depth) for r in got.collect()} == {(s, x, d) for s in seeds for x, d in reference_reach(pairs, s).items()}
        closed = {(r.src, r.dst) for r in graph.closure(graph.adjacency(e, graph.UP)).collect()}
        assert closed == {(s, x) for s in {a for a, _ in pairs} for x in reference_reach(pairs, s)}


def test_start_is_related_only_on_a_cycle(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    g = graph_of(spark, nodes(spark, [(x, "column", x) for x in "abc"]), e)
    related, _, left = graph.subgraph(g, "a", graph.UP, "derives_from")
    assert {r.node_id for r in related.collect()} == {"a", "b", "c"} and left.count() == 3
    assert graph.subgraph(g, "c", graph.UP, "derives_from")[0].count() == 0


def test_selectors_and_induced(spark):
    g = graph_of(spark, nodes(spark, [("table:a", "table", "a"), ("column:a.x", "column", "x"), ("metric:m", "metric", "m")]), edges(spark, [("column:a.x", "column:a.x"), ("column:a.x", "metric:m")]), spark.createDataFrame([("c", "m", None, "metric:m"), ("c", "n", None, None)], "code string, message string, location string, subject_id string"))
    s = graph.select(g, "kind:column")
    assert (s.nodes.count(), s.edges.count(), s.warnings.count()) == (1, 1, 1)
    assert graph.select(g, "id:table:").nodes.count() == 1
    assert graph.select(g, "metric", clear_warnings=True).warnings.count() == 0
    with pytest.raises(GraphError):
        graph.select(g, "what:x")
    with pytest.raises(GraphError):
        graph.node(g, "nope")
    assert graph.has_node(g, "table:a")


def test_merge_left_wins_whatever_the_partitions(spark):
    a = graph_of(spark, nodes(spark, [("column:a.x", "column", "x", None), ("table:a", "table", "a", "")], "id string, kind string, name string, qualified_name string"))
    b = graph_of(spark, nodes(spark, [("column:a.x", "column", "X", "a.x"), ("table:a", "table", "a", "db.a")], "id string, kind string, name string, qualified_name string"))
    for n in (1, 7):
        g = merge.merge(a.with_(nodes=a.nodes.repartition(n)), b.with_(nodes=b.nodes.repartition(n)), b)
        rows = {r.id: (r.name, r.qualified_name) for r in g.nodes.collect()}
        assert rows == {"column:a.x": ("x", "a.x"), "table:a": ("a", "db.a")}
        assert [r.message for r in g.warnings.collect()] == ["'column:a.x' differs by source in node.name: 'x' vs 'X'"]
    again = merge.merge(g, g)
    assert sorted(map(str, again.nodes.collect())) == sorted(map(str, g.nodes.collect()))


def test_merge_conflicts(spark):
    a, b = (graph_of(spark, nodes(spark, [("x", k, "x")])) for k in ("table", "column"))
    with pytest.raises(Exception, match="is of several kinds"):
        merge.merge(a, b).nodes.collect()
    with pytest.raises(GraphError):
        merge.merge(a, type(a)(a.nodes, a.edges, a.warnings, "2"))


def test_match_tiers(spark):
    targets = spark.createDataFrame([("t1", "db.s.a"), ("t2", "db.s.b"), ("t3", "db.r.b"), ("t4", "c")], "target_id string, name string")
    subjects = spark.createDataFrame([("exact", ["db.s.a"]), ("suffix", ["x", "s.a"]), ("two", ["b"]), ("stop", ["b", "c"]), ("none", ["q"]), ("later", ["q", "c"])], "subject_id string, candidates array<string>")
    got = {r.subject_id: (r.target_id, r.status) for r in match.match(subjects, targets).collect()}
    assert got == {"exact": ("t1", "resolved"), "suffix": ("t1", "resolved"), "two": (None, "ambiguous"), "stop": (None, "ambiguous"), "none": (None, "unresolved"), "later": ("t4", "resolved")}


def test_checks_and_posture(spark):
    g = graph_of(spark, nodes(spark, [("a", "table", "a"), ("a", "table", "a"), ("b", "table", "b")]), edges(spark, [("a", "zz")]))
    found = {(r.check_id, r.severity) for r in checks.run_checks(g, "permissive").collect()}
    assert found == {("check.unique_node_ids", "error"), ("check.edges_resolve", "error")}
    with pytest.raises(GraphError):
        checks.enforce_checks(g)
    empty = graph_of(spark, nodes(spark, [("a", "table", "a")]))
    assert [(r.check_id, r.severity) for r in checks.enforce_checks(empty, "strict").collect()] == [("check.zero_column_lineage", "warn")]
    with pytest.raises(GraphError):
        checks.run_checks(g, "loose")


RULES = "id string, kind string, identity string, effect string, selector_kind string"


def test_policy_fails_closed(spark):
    n = graph_of(spark, spark.createDataFrame([("t", "table", "t", None), ("c", "column", "c", {"classification": '"pii"'}), ("m", "metric", "m", {"ai_behavior": '{"allowed":true}', "note": "1"})], "id string, kind string, name string, aspects map<string,string>"))

    def decide(rows):
        rules = spark.createDataFrame(rows, RULES)
        return {r.id: r.decision for r in policy.gate(n.nodes, rules, "me").select("id", "decision").collect()}

    assert decide([]) == {"t": "deny", "c": "deny", "m": "deny"}
    assert decide([("1", "rbac", "me", "allow", None)]) == {"t": "allow", "c": "deny", "m": "deny"}
    assert decide([("1", "rbac", "me", "allow", None), ("2", "rbac", "me", "deny", "table")])["t"] == "deny"
    assert decide([("1", "rls", "me", "allow", None)])["t"] == "filter"
    rules = spark.createDataFrame([("1", "masking", "me", "allow", "table")], RULES)
    out = policy.apply_policy(n, rules, "me").nodes.collect()
    assert [(r.id, r.aspects) for r in out] == [("t", {"_policy_masked": "true"})]
    with pytest.raises(GraphError):
        policy.apply_policy(n, rules, " ")
    with pytest.raises(PermissionError):
        policy.require_allow(n.nodes, rules, "you")
    assert len(policy.floor_violations(n.nodes).collect()) == 2


def test_emit(spark):
    g = graph_of(spark, nodes(spark, [("table:a", "table", "a"), ("column:a.x", "column", "x"), ("column:b.y", "column", "y")]), edges(spark, [("column:a.x", "column:b.y")]))
    doc = graph_dict(g)
    assert validate(doc) == [] and [n["id"] for n in doc["nodes"]] == ["column:a.x", "column:b.y", "table:a"]
    assert "columnLineage" in emit(g, "openlineage") and "derives_from: 1" in emit(g, "text")
    assert graph_rows(g).filter(F.col("section") == "nodes").count() == 3
    with pytest.raises(GraphError):
        emit(g, "ai-context")
    rules = spark.createDataFrame([("1", "rbac", "me", "allow", None)], RULES)
    assert '"node_count": 3' in emit(g, "consumer-catalog", "me", rules)
    t = graph.impact(g, "column:b.y")
    assert "column:a.x" in emit_impact(t) and t.completeness == "unknown" and "flowchart" in emit_impact(t, "mermaid")
    assert validate({"version": "2", "nodes": [{"id": "x"}], "edges": []})
    assert graph.tree("a", [("a", "b"), ("b", "a")]) == "a\n  b\n    a (cycle)\n"


def aggregates(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")


def test_merge_groups_each_relation_once(spark):
    n = [spark.range(3).select(F.concat(F.lit("table:"), "id").alias("id"), F.lit("table").alias("kind"), F.lit(x).alias("name")) for x in "ab"]
    e = [spark.range(3).select(F.lit("feeds").alias("kind"), F.concat(F.lit("t:"), "id").alias("source_id"), F.lit("u").alias("target_id"), F.lit(x).alias("label")) for x in "ab"]
    graphs = [graph_of(spark, *both) for both in zip(n, e, strict=True)]
    for merged in (merge.merge_nodes([g.nodes for g in graphs]), merge.merge_edges([g.edges for g in graphs])):
        assert [aggregates(df) for df in merged] == [1, 1]
        assert merged[1].count() == 3


def test_merge_edges_query_counts_each_edge_in_one_pass(spark, tmp_path):
    lines = [(1, 1, "A"), (1, 1, "R"), (1, 2, "N"), (1, 2, "N"), (None, 2, "A"), (None, 2, "N"), (3, 3, None), (3, 3, "R")]
    spark.createDataFrame(lines, "l_partkey bigint, l_suppkey bigint, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = data_graph.merge_edges(spark, str(tmp_path))
    rows = {(r.source_id, r.target_id): (r.label, r.n_warnings) for r in out.collect()}
    assert rows == {("part:1", "supplier:1"): ("A", 1), ("part:1", "supplier:2"): ("N", 0), (None, "supplier:2"): ("A", 1), ("part:3", "supplier:3"): ("R", 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert aggregates(out) == 2 and plan.count("Relation [") == 1 and "Join" not in plan
