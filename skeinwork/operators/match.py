"""Tiered name matching and physical binding as equi-joins.

``endswith`` over all targets would be a nested loop; instead every target is exploded into its dotted
suffixes, so that exact and suffix hits are one hash join on the candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.identity import apply_aliases, fqn_candidates, split_identifier
from skeinwork.schemas import Graph


def suffix_index(targets: DataFrame) -> DataFrame:
    """(target_id, name) -> (key, target_id, exact): a row per dotted suffix of the name."""
    parts = F.split("name", r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("key"), (i == 1).alias("exact")))
    return targets.select("target_id", F.explode(keys).alias("k")).select("target_id", "k.key", "k.exact")


def match(subjects: DataFrame, targets: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(subject_id, candidates) against (target_id, name) -> (subject_id, target_id, status).

    Candidates are tried in order: an exact hit resolves; else one suffix hit resolves and several are
    ambiguous, which ends the search; no hit goes on to the next candidate; none at all is unresolved.
    """
    tried = subjects.select("subject_id", F.posexplode("candidates").alias("tier", "key"))
    if aliases is not None:
        tried = apply_aliases(tried, "key", aliases)
    hits = tried.join(suffix_index(targets), "key")
    tier = hits.groupBy("subject_id", "tier").agg(
        F.min(F.when(F.col("exact"), F.col("target_id"))).alias("exact_id"),
        F.min(F.when(~F.col("exact"), F.col("target_id"))).alias("low"),
        F.max(F.when(~F.col("exact"), F.col("target_id"))).alias("high"),
    )
    first = tier.groupBy("subject_id").agg(F.min_by(F.struct("exact_id", "low", "high"), "tier").alias("t"))
    single = F.coalesce("t.exact_id", F.when(F.col("t.low") == F.col("t.high"), F.col("t.low")))
    status = F.when(F.col("t").isNull(), "unresolved").when(single.isNotNull(), "resolved").otherwise("ambiguous")
    return subjects.select("subject_id").join(first, "subject_id", "left").select("subject_id", single.alias("target_id"), status.alias("status"))


def _names(tables: DataFrame) -> DataFrame:
    return tables.select(F.col("id").alias("target_id"), F.expr("substring(id, length('table:') + 1)").alias("name"))


def attach_bindings(g: Graph, warehouse: Graph, aliases: DataFrame | None = None) -> Graph:
    """Bindings of warehouse tables and columns on nodes that lack them; what can't be bound is warned about.

    A node from the warehouse itself (it has ``warehouse_metadata``) or one with bindings stays as it is.
    A column binds by its table, then by its exact name there. A warehouse node whose binding went to a node of
    another id gives it up.
    """
    nodes = g.nodes
    native = F.coalesce(F.map_contains_key("aspects", "warehouse_metadata"), F.lit(False))
    bound = F.coalesce(F.size("bindings"), F.lit(0)) > 0
    open_ = nodes.filter(F.col("kind").isin("table", "column") & ~native & ~bound)
    parts = split_identifier(F.col("qualified_name"))
    blank = F.coalesce(F.col("qualified_name"), F.lit("")) == ""
    is_column = F.col("kind") == "column"
    parent = F.when(is_column, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ".")).otherwise(F.col("qualified_name"))
    open_ = open_.select("id", "kind", blank.alias("blank"), (is_column & (F.size(parts) < 2)).alias("short"), fqn_candidates(parent).alias("candidates"), F.when(is_column, F.element_at(parts, -1)).alias("column"))
    tables = warehouse.nodes.filter("kind = 'table'")
    found = match(open_.filter("not blank and not short and candidates is not null").select(F.col("id").alias("subject_id"), "candidates"), _names(tables), aliases)
    open_ = open_.join(found, open_["id"] == found["subject_id"], "left").withColumn("status", F.coalesce("status", F.lit("unresolved")))
    table_bindings = tables.select(F.col("id").alias("target_id"), F.col("bindings").alias("t_bindings"))
    columns = warehouse.nodes.filter("kind = 'column'").select(F.col("id").alias("c_id"), F.explode("bindings").alias("b"), F.col("bindings").alias("c_bindings"), "qualified_name")
    owner = F.concat(F.lit("table:"), F.regexp_extract("c_id", r"^column:(.*)\.[^.]+$", 1))
    columns = columns.select("c_id", owner.alias("target_id"), F.col("b.column").alias("column"), "c_bindings").dropDuplicates(["target_id", "column"])
    open_ = open_.join(table_bindings, "target_id", "left").join(columns, ["target_id", "column"], "left")
    gain = F.when(F.col("kind") == "table", F.col("t_bindings")).otherwise(F.col("c_bindings"))
    giver = F.when(F.col("kind") == "table", F.col("target_id")).otherwise(F.col("c_id"))
    ok = (F.col("status") == "resolved") & gain.isNotNull()
    result = open_.withColumn("gain", F.when(ok, gain)).withColumn("giver", F.when(ok & (giver != F.col("id")), giver))
    message = (
        F.when(F.col("blank"), F.concat(F.lit("Nothing to look "), "id", F.lit(" up by: its qualified_name is empty")))
        .when(F.col("short"), F.concat(F.lit("The qualified_name of "), "id", F.lit(" has no table part")))
        .when((F.col("kind") == "column") & (F.col("status") == "resolved"), F.concat("target_id", F.lit(" has no column '"), "column", F.lit("' for "), "id"))
        .when(F.col("kind") == "column", F.concat(F.lit("The table of "), "id", F.lit(" is "), "status", F.lit(" in the warehouse")))
        .otherwise(F.concat("id", F.lit(" is "), "status", F.lit(" in the warehouse")))
    )
    code = F.when(F.col("status") == "ambiguous", "warehouse_bind_ambiguous").otherwise("warehouse_bind_unresolved")
    warnings = result.filter("gain is null").select(code.alias("code"), message.alias("message"), F.lit(None).cast("string").alias("location"), F.col("id").alias("subject_id"))
    gains = result.filter("gain is not null").select("id", "gain")
    givers = result.filter("giver is not null").select(F.col("giver").alias("id")).distinct().withColumn("gave", F.lit(True))
    final = nodes.join(gains, "id", "left").join(givers, "id", "left")
    bindings = F.when(F.col("gave"), F.lit(None)).otherwise(F.coalesce("gain", "bindings"))
    return g.with_(nodes=final.withColumn("bindings", bindings).select(*nodes.columns)).add_warnings(warnings)


def rematch_feeds(g: Graph, warehouse: Graph, aliases: DataFrame | None = None) -> Graph:
    """Every ``feeds`` edge that isn't resolved is matched again to warehouse tables; without a match it keeps its source."""
    name = F.expr("substring(source_id, length('table:') + 1)")
    feeds = g.edges.filter("kind = 'feeds' and coalesce(match_status, '') <> 'resolved'")
    subjects = feeds.select(F.col("source_id").alias("subject_id"), fqn_candidates(name).alias("candidates")).distinct().filter("candidates is not null")
    found = match(subjects, _names(warehouse.nodes.filter("kind = 'table'")), aliases).withColumnRenamed("subject_id", "source_id")
    hit = found.select("source_id", F.col("target_id").alias("hit"), "status")
    moved = feeds.join(hit, "source_id", "left")
    moved = moved.withColumn("match_status", F.coalesce("status", "match_status")).withColumn("source_id", F.coalesce("hit", "source_id")).select(*g.edges.columns)
    rest = g.edges.filter("not (kind = 'feeds' and coalesce(match_status, '') <> 'resolved')")
    return g.with_(edges=rest.unionByName(moved))

