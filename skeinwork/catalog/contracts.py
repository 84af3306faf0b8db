"""Query contracts compiled, gated and run over the tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.plans.parsing import parse
from skeinwork.plans.values import table_refs
from skeinwork.runtime import TABLES, execute_contract, register_tables
from skeinwork.schemas import graph_of
from skeinwork.sources.registry import compile_contracts

CONTRACTS = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "shipping_priority": """
        SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10""",
    "local_supplier_volume": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "revenue_forecast": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "customer_rank": """
        SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS place, lag(c_custkey, 1, -1) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS above FROM customer""",
    "running_total": """
        SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three FROM orders""",
    "segments_cube": """
        SELECT c_mktsegment, coalesce(c_nationkey, -1) AS nation, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())""",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "customers_with_orders": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type",
    "set_difference": "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "set_intersection": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "part_types": "SELECT p_brand, count(DISTINCT p_type) AS n_types, max(p_size) AS largest FROM part GROUP BY p_brand HAVING count(*) > 1",
    "priority_mix": """
        SELECT o_orderstatus, sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END)::BIGINT AS urgent, count(*) AS n FROM orders GROUP BY o_orderstatus""",
    "non_equi": """
        SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "full_outer": """
        SELECT coalesce(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) c
        FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON c.k = s.k""",
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        needed = table_refs(parse(spark, CONTRACTS[name]))
        register_tables(spark, sf_dir, tuple(t for t in TABLES if t in needed))
        aspects = {"query": json.dumps({"sql": CONTRACTS[name]})}
        nodes = spark.createDataFrame([(f"query:{name}", "query", name, aspects)], "id string, kind string, name string, aspects map<string,string>")
        g = compile_contracts(spark, graph_of(spark, nodes))
        rules = spark.createDataFrame([("open", "rbac", "analyst", "allow", "query")], "id string, kind string, identity string, effect string, selector_kind string")
        return execute_contract(spark, g, rules, "analyst", f"query:{name}")

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"contract_{name}": _run(name) for name in CONTRACTS}


def oracle_sql() -> dict[str, str]:
    return {f"contract_{name}": sql for name, sql in CONTRACTS.items()}
