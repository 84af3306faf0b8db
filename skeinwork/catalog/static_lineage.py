"""Value lineage of an embedded project of models over the tables, whose schemas come from the files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.graph import DOWN, UP, impact
from skeinwork.plans.project import Dataset, compile_project, coverage, coverage_summary, status_summary
from skeinwork.schemas import Graph

ROOTS = ("lineitem", "orders", "customer", "nation", "region")
MODELS = {
    "stg_lineitem": "select l_orderkey as order_id, l_extendedprice * (1 - l_discount) as net, l_quantity as quantity, l_returnflag from lineitem where l_tax >= 0",
    "stg_orders": "select o_orderkey as order_id, o_custkey as customer_id, case when o_orderstatus = 'F' then o_totalprice else 0 end as closed, case when o_orderpriority = 'x' then 1 end as urgent from orders",
    "fct_revenue": "select o.customer_id, sum(l.net) as revenue, count(*) as n from stg_orders o join stg_lineitem l on o.order_id = l.order_id group by o.customer_id having sum(l.net) > 0",
    "dim_customer": "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "fct_rank": "select customer_id, revenue, row_number() over (order by revenue desc) as place, sum(revenue) over (partition by n order by customer_id) as total from fct_revenue",
    "rpt_region": "with base as (select d.r_name, f.revenue from fct_revenue f join dim_customer d on f.customer_id = d.c_custkey), agg as (select r_name, sum(revenue) as revenue from base group by r_name) select r_name, revenue from agg",
    "rpt_star": "select * from fct_revenue where n > 1",
    "rpt_union": "select c_custkey as id from customer union all select o_orderkey from orders",
    "rpt_quoted": 'select c_name as "Name" from customer',
    "rpt_scalar": "select c_custkey, (select max(o.o_totalprice) from orders o where o.o_custkey = c.c_custkey) as best from customer c",
}
NEEDS = {
    "stg_lineitem": ["lineitem"], "stg_orders": ["orders"], "fct_revenue": ["stg_orders", "stg_lineitem"], "dim_customer": ["customer", "nation", "region"], "fct_rank": ["fct_revenue"],
    "rpt_region": ["fct_revenue", "dim_customer"], "rpt_star": ["fct_revenue"], "rpt_union": ["customer", "orders"], "rpt_quoted": ["customer"], "rpt_scalar": ["customer", "orders"],
}
# What each output derives from, written by hand.
EDGES = {
    "stg_lineitem": {"order_id": ["lineitem.l_orderkey"], "net": ["lineitem.l_extendedprice", "lineitem.l_discount"], "quantity": ["lineitem.l_quantity"], "l_returnflag": ["lineitem.l_returnflag"]},
    "stg_orders": {"order_id": ["orders.o_orderkey"], "customer_id": ["orders.o_custkey"], "closed": ["orders.o_totalprice"], "urgent": ["orders.o_orderpriority"]},
    "fct_revenue": {"customer_id": ["stg_orders.customer_id"], "revenue": ["stg_lineitem.net"]},
    "dim_customer": {"c_custkey": ["customer.c_custkey"], "n_name": ["nation.n_name"], "r_name": ["region.r_name"]},
    "fct_rank": {"customer_id": ["fct_revenue.customer_id"], "revenue": ["fct_revenue.revenue"], "total": ["fct_revenue.revenue"]},
    "rpt_region": {"r_name": ["dim_customer.r_name"], "revenue": ["fct_revenue.revenue"]},
    "rpt_star": {"customer_id": ["fct_revenue.customer_id"], "revenue": ["fct_revenue.revenue"], "n": ["fct_revenue.n"]},
    "rpt_scalar": {"c_custkey": ["customer.c_custkey"], "best": ["orders.o_totalprice"]},
}
WARNINGS = [
    ("unresolved_output_source", "column:fct_revenue.n"), ("unresolved_lineage", "column:fct_revenue.n"), ("unresolved_output_source", "column:fct_rank.place"), ("unresolved_lineage", "column:fct_rank.place"),
    ("select_star_expanded", "table:rpt_star"), ("unresolved_lineage", "column:rpt_union.id"), ("unresolved_lineage", "column:rpt_quoted.name"),
]
STATUS = {"complete": 6, "partial": 3, "unsupported": 1}


def project_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The project compiled; root schemas are read from the Parquet footers."""
    roots = [Dataset(t, "root", columns=spark.read.parquet(f"{sf_dir}/{t}.parquet").columns) for t in ROOTS]
    return compile_project(spark, [*roots, *[Dataset(n, "local", sql, NEEDS[n]) for n, sql in MODELS.items()]])


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_graph(spark, sf_dir).edges.filter("kind = 'derives_from'").select("source_id", "target_id")


def lineage_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_graph(spark, sf_dir).edges.filter("kind = 'depends_on'").select("source_id", "target_id")


def lineage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_graph(spark, sf_dir).warnings.select("code", "subject_id")


def lineage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_summary(project_graph(spark, sf_dir))


def lineage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project_graph(spark, sf_dir)
    roots = spark.createDataFrame([(f"table:{t}",) for t in ROOTS], "id string")
    return coverage_summary(coverage(g, roots)).select("total", "resolved", "flagged", "silent")


def impact_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact(project_graph(spark, sf_dir), "column:lineitem.l_extendedprice", DOWN).related


def impact_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact(project_graph(spark, sf_dir), "column:rpt_region.revenue", UP).related


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (lineage_edges, lineage_dependencies, lineage_warnings, lineage_status, lineage_coverage, impact_downstream, impact_upstream)}


def _values(rows: list[tuple], names: str) -> str:
    show = lambda x: str(x) if isinstance(x, int) else "'" + str(x) + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


def oracle_sql() -> dict[str, str]:
    edges = [(f"column:{m}.{c}", f"column:{up}") for m, outs in EDGES.items() for c, ups in outs.items() for up in ups]
    needs = [(f"table:{m}", f"table:{d}") for m, ds in NEEDS.items() for d in ds]
    down = [("column:stg_lineitem.net", 1), ("column:fct_revenue.revenue", 2), ("column:fct_rank.revenue", 3), ("column:fct_rank.total", 3), ("column:rpt_region.revenue", 3), ("column:rpt_star.revenue", 3)]
    up = [("column:fct_revenue.revenue", 1), ("column:stg_lineitem.net", 2), ("column:lineitem.l_extendedprice", 3), ("column:lineitem.l_discount", 3)]
    columns = 11 + 6 + 5 + 3 + 2  # of the roots
    outputs, flagged = sum(map(len, EDGES.values())) + 2 + 2, 4
    return {
        "lineage_edges": _values(edges, "source_id, target_id"),
        "lineage_dependencies": _values(needs, "source_id, target_id"),
        "lineage_warnings": _values(WARNINGS, "code, subject_id"),
        "lineage_status": "SELECT status, n::BIGINT AS n FROM (" + _values(list(STATUS.items()), "status, n") + ")",
        "lineage_coverage": f"SELECT {columns + outputs}::BIGINT AS total, {outputs - flagged}::BIGINT AS resolved, {flagged}::BIGINT AS flagged, 0::BIGINT AS silent",
        "impact_downstream": _values(down, "node_id, depth"),
        "impact_upstream": _values(up, "node_id, depth"),
    }
