import json
import threading
import urllib.error
import urllib.request

import pytest

from skeinwork.emit.bundle import build_bundle, bundle_problems, validate_bundle
from skeinwork.plans.cache import compile_cached
from skeinwork.plans.project import Dataset
from skeinwork.schemas import GraphError, graph_of
from skeinwork.serve import server

RULES = "id string, kind string, identity string, effect string, selector_kind string"


def test_server(spark):
    nodes = spark.createDataFrame([("query:q", "query", "q", {"query": json.dumps({"sql": "x", "compiled_sql": "select 1 as one"})})], "id string, kind string, name string, aspects map<string,string>")
    rules = spark.createDataFrame([("1", "rbac", "me", "allow", None)], RULES)
    s, other = (server(spark, graph_of(spark, nodes), rules, who) for who in ("me", "you"))
    for one in (s, other):
        threading.Thread(target=one.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"

    def ask(body, at=None):
        raw = body if isinstance(body, bytes) else json.dumps(body).encode()
        return json.loads(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{(at or s).server_port}/query", raw), timeout=60).read())

    assert json.loads(urllib.request.urlopen(url + "/health", timeout=60).read()) == {"status": "ok"}
    assert ask({"query": "query:q"}) == {"rows": [{"one": 1}]}
    wrong = [(403, {"query": "query:q"}, other), (500, {"query": "query:zz"}, s), (400, {"identity": "me", "query": "query:q"}, other), (400, b"{", s), (400, [1], s), (400, {"query": 1}, s)]
    for status, body, at in wrong:
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(body, at)
        assert e.value.code == status
    s.shutdown()
    other.shutdown()
    with pytest.raises(GraphError):
        server(spark, graph_of(spark, nodes), rules, "me", "0.0.0.0")


def test_cache_and_bundle(spark, tmp_path):
    ds = [Dataset("a", "root", columns=["x"]), Dataset("b", sql="select x as y from a", dependencies=["a"]), Dataset("c", sql="select x from a", dependencies=["a"])]
    folder = str(tmp_path / "cache")
    g = compile_cached(spark, ds, folder, ["b"])
    assert {r.id for r in g.nodes.filter("kind = 'table'").collect()} == {"table:a", "table:b"}
    again = compile_cached(spark, ds, folder, ["b"])
    assert again.edges.inputFiles() and len(list((tmp_path / "cache").iterdir())) == 1
    ds[1].sql = "select x as z from a"
    assert "column:b.z" in {r.id for r in compile_cached(spark, ds, folder, ["b"]).nodes.collect()}
    build_bundle(g, str(tmp_path / "bundle"), {"x": ("a.x", "downstream")}, "x")
    assert validate_bundle(str(tmp_path / "bundle")) == []
    assert "column:b.y" in (tmp_path / "bundle" / "impact-x.json").read_text()
    with pytest.raises(GraphError):
        build_bundle(g, str(tmp_path / "bundle"), {}, "zz")
    assert bundle_problems({}) != []
