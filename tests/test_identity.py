import pytest
from pyspark.sql import functions as F

from skeinwork.functions import identity as I
from skeinwork.functions import selections as S
from skeinwork.schemas import GraphError


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "s string").select(*columns).collect()]


def test_split_and_normalise(spark):
    rows = ["A.b", '"X.Y".z', "`q`.[r s].t", "a..b", '"open', " a . b ", "*", None]
    got = values(spark, rows, I.split_identifier(F.col("s")), I.normalize(F.col("s")))
    assert [g[0] for g in got] == [["A", "b"], ['"X.Y"', "z"], ["`q`", "[r s]", "t"], None, None, ["a", "b"], ["*"], None]
    assert [g[1] for g in got] == ["a.b", "x.y.z", "q.r s.t", None, None, "a.b", None, None]


def test_driver_twins_agree(spark):
    for text in ["A.b", '"X.Y".z', "`q`.[r s].t"]:
        assert S.normal(text) == values(spark, [text], I.normalize(F.col("s")))[0][0]
    for bad in ["a..b", '"open', "", "*"]:
        with pytest.raises(GraphError):
            S.normal(bad)


def test_candidates_and_types(spark):
    got = values(spark, ["DB.S.T", "T", "a.b.c.d"], I.fqn_candidates(F.col("s")))
    assert [g[0] for g in got] == [["db.s.t", "s.t", "t"], ["t"], None]
    types = values(spark, ["VARCHAR(255)", " Numeric(10, 2) ", "geometry", None], I.canonical_type(F.col("s")))
    assert [t[0] for t in types] == ["varchar", "decimal", None, None]
    assert values(spark, ["int64"], I.canonical_type(F.col("s"), "bigquery")) == [("bigint",)]


def test_ids_and_keys(spark):
    assert values(spark, ["A.B"], I.make_id("table", F.col("s")), I.leaf_name(F.col("s")), I.schema_name(F.col("s"))) == [("table:a.b", "B", "A")]
    assert values(spark, ["a.b.c.d"], I.lookup_keys(F.col("s"))) == [(["a.b.c.d", "b.c.d", "c.d"],)]
    assert values(spark, ["models/x.y.sql"], I.dataset_of(F.col("s"))) == [("x",)]
    row = spark.createDataFrame([("column:a.b.c",), ("table:x",)], "s string").select(I.column_selection(F.col("s")).alias("c")).collect()
    assert tuple(row[0].c) == ("a.b", "c") and row[1].c is None


def test_selections():
    assert S.column_selection("column.A.b") == "column:a.b"
    assert S.impact_selection("metric:X") == "metric:x"
    assert S.impact_selection("query.x") == "column:query.x"
    assert S.query_selection("query.x") == "query:x"
    with pytest.raises(GraphError):
        S.column_selection("x")


def test_aliases(spark):
    df = spark.createDataFrame([("A.B",), ("c",)], "n string")
    aliases = spark.createDataFrame([("a.b", "X.Y")], "alias string, target string")
    assert sorted(r.n for r in I.apply_aliases(df, "n", aliases).collect()) == ["c", "x.y"]


def test_a_name_is_split_once_however_often_it_is_used(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("s"))
    for use in (I.split_identifier, I.normalize, I.fqn_candidates, I.schema_name, I.leaf_name):
        plan = df.select(use(F.col("s")).alias("out"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, plan


def test_long_names(spark):
    long = "Ab c" * 25_000
    rows = [f"{long} . T", f"{long}..t", f"{long}.[open"]
    got = values(spark, rows, I.split_identifier(F.col("s")), I.normalize(F.col("s")), I.fqn_candidates(F.col("s")))
    low = long.lower()
    assert got == [([long, "T"], f"{low}.t", [f"{low}.t", "t"]), (None, None, None), (None, None, None)]
