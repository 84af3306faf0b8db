"""Policy: decisions per node, the security floor, and gated projection. Everything fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.checks import raise_all
from skeinwork.schemas import Graph, GraphError

# Fixed value: aspects that never leave.
SENSITIVE = ("classification", "policy_refs", "ai_behavior", "pii", "confidential")


def gated_identity(identity: str | None) -> str:
    if not identity or not identity.strip():
        raise GraphError("an identity is required")
    return identity.strip()


def decisions(nodes: DataFrame, rules: DataFrame, identity: str) -> DataFrame:
    """``nodes`` with ``decision``: deny beats mask, mask beats filter, filter beats allow; no rule is deny.

    The identity's rules are folded to one row per kind, and one for all kinds, before the join, so nodes are
    never multiplied.
    """
    rules = rules.filter(F.col("identity") == identity)
    flags = [
        F.bool_or(F.col("effect") == "deny").alias("deny"),
        F.bool_or((F.col("kind") == "masking") | (F.col("effect") == "mask")).alias("mask"),
        F.bool_or((F.col("kind") == "rls") & (F.col("effect") == "allow")).alias("rls"),
        F.bool_or(F.col("effect") == "allow").alias("allow"),
    ]
    general = rules.filter("selector_kind is null").agg(*flags).first()  # one row
    special = rules.filter("selector_kind is not null").groupBy(F.col("selector_kind").alias("__kind")).agg(*flags)
    yes = lambda c: F.lit(bool(general[c])) | F.coalesce(F.col(c), F.lit(False))
    decision = F.when(yes("deny"), "deny").when(yes("mask"), "mask").when(yes("rls"), "filter").when(yes("allow"), "allow").otherwise("deny")
    joined = nodes.join(special, nodes["kind"] == F.col("__kind"), "left")
    return joined.withColumn("decision", decision).select(*nodes.columns, "decision")


def _text(key: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col("aspects")[key], F.lit("")), r'^"(.*)"$', "$1")


def _blank(key: str) -> Column:
    return F.coalesce(F.trim(F.col("aspects")[key]), F.lit("")).isin("", "null", '""', "[]", "{}", "false", "0")


def floor_violations(nodes: DataFrame) -> DataFrame:
    """(id, violation): AI behaviour without a classification, or classified as pii or confidential without policy_refs."""
    ai = F.coalesce(F.get_json_object(F.col("aspects")["ai_behavior"], "$.allowed") == "true", F.lit(False)) & _blank("classification")
    label = _text("classification")
    closed = label.isin("pii", "confidential") & _blank("policy_refs")
    found = F.filter(
        F.array(
            F.when(ai, F.concat("id", F.lit(" lets AI act but has no classification"))),
            F.when(closed, F.concat("id", F.lit(" is '"), label, F.lit("' but names no policy"))),
        ),
        lambda v: v.isNotNull(),
    )
    return nodes.filter("aspects is not null").select("id", F.explode(found).alias("violation"))


def enforce_floor(g: Graph) -> None:
    raise_all(floor_violations(g.nodes).select(F.col("violation").alias("message")))


def gate(nodes: DataFrame, rules: DataFrame, identity: str) -> DataFrame:
    """``decisions``, with allow and mask turned to deny below the security floor."""
    low = floor_violations(nodes).select("id").distinct().withColumn("low", F.lit(True))
    found = decisions(nodes, rules, identity).join(low, "id", "left")
    closed = F.col("decision").isin("allow", "mask") & F.coalesce("low", F.lit(False))
    return found.withColumn("decision", F.when(closed, "deny").otherwise(F.col("decision"))).drop("low")


def allowed_only(nodes: DataFrame, rules: DataFrame, identity: str) -> DataFrame:
    return gate(nodes, rules, identity).filter("decision = 'allow'").drop("decision")


def require_allow(nodes: DataFrame, rules: DataFrame, identity: str) -> None:
    """Raise unless every given node is allowed."""
    row = gate(nodes, rules, identity).filter("decision <> 'allow'").select("id").first()
    if row:
        raise PermissionError(f"{row.id} denied by policy for identity {identity!r}")


def apply_policy(g: Graph, rules: DataFrame, identity: str) -> Graph:
    """What an identity may see: denied and filtered nodes go, sensitive aspects go, masked nodes are marked, edges and warnings follow."""
    kept = gate(g.nodes, rules, gated_identity(identity)).filter("decision in ('allow', 'mask')")
    open_ = F.map_filter(F.coalesce("aspects", F.create_map().cast("map<string,string>")), lambda k, _v: ~k.isin(*SENSITIVE))
    marked = F.when(F.col("decision") == "mask", F.map_concat(F.map_filter(open_, lambda k, _v: k != "_policy_masked"), F.create_map(F.lit("_policy_masked"), F.lit("true")))).otherwise(open_)
    from skeinwork.operators.graph import induced

    return induced(g, kept.withColumn("aspects", marked).select(*g.nodes.columns))
