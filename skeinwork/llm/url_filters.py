"""URL filters: rules first, then a path-template tree with smoothed label purity. DataFrame functions only.

A url's path becomes a template: segments that hold a digit or are long turn into ``*``. Level by level
from the root, siblings whose share of blocked labels doesn't differ significantly from that of their
other siblings merge into ``*``, with their subtrees. A template is rejected when its smoothed share of
blocked labels reaches a threshold. Labels are the verdicts of the rules.

The tree is built on counts per distinct template, not on pages: a host with a third of all pages adds
few rows, and all sums are partial aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.shared import cut, plain

#: (verdict, rule): host, then the path's beginning.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DEPTH = 3
LONG_SEGMENT = 24
Z = 1.96
STRENGTH = 2.0
PRIOR = 0.25
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as ``verdict:rule``; null if none does. One expression per rule: meant for up to some hundred rules."""
    options = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        options.append(F.when(fits, F.lit(f"{verdict}:{rule}")))
    return F.coalesce(*options, F.lit(None).cast("string"))


def _segments(path: Column) -> list[Column]:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    variable = lambda s: s.rlike("[0-9]") | (F.length(s) > LONG_SEGMENT)
    each = F.transform(parts, lambda s: F.when(variable(s), F.lit("*")).otherwise(s))
    one = [F.coalesce(F.get(each, F.lit(i)), F.lit("")) for i in range(DEPTH - 1)]
    rest = F.array_join(F.slice(each, DEPTH, F.greatest(F.size(each), F.lit(1))), "/")
    return [*one, rest]


def templates(pages: DataFrame, url_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """pages with host, path, rule, label (1 blocked, 0 allowed, null) and the segments s1.. of the template; the last holds all further ones."""
    found = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    found = found.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    label = F.when(F.startswith("hit", F.lit("block:")), 1).when(F.col("hit").isNotNull(), 0)
    segments = {f"s{i + 1}": s for i, s in enumerate(_segments(F.col("path")))}
    return found.withColumn("label", label).withColumns(segments)


def template_tree(found: DataFrame) -> DataFrame:
    """host, s1.. -> template and its smoothed share of blocked labels."""
    keys = [f"s{i + 1}" for i in range(DEPTH)]
    tree = found.groupBy("host", *keys).agg(F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    tree = cut(tree.withColumn("template", F.lit("")), "url-templates")
    for key in keys:
        branch = tree.groupBy("host", "template", key).agg(F.sum("lab").alias("b_lab"), F.sum("bad").alias("b_bad"))
        parent = branch.groupBy("host", "template").agg(F.sum("b_lab").alias("p_lab"), F.sum("b_bad").alias("p_bad"))
        rest_lab, rest_bad = F.col("p_lab") - F.col("b_lab"), F.col("p_bad") - F.col("b_bad")
        share = lambda bad, lab: (bad + STRENGTH * PRIOR) / (lab + STRENGTH)
        pooled = share(F.col("p_bad"), F.col("p_lab"))
        gap = F.abs(share(F.col("b_bad"), F.col("b_lab")) - share(rest_bad, rest_lab))
        error = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("b_lab") + STRENGTH) + 1 / (rest_lab + STRENGTH)))
        step = F.when(F.col(key) == "", F.lit("")).when(gap > Z * error, F.col(key)).otherwise(F.lit("*"))
        branch = branch.join(parent, ["host", "template"]).select("host", "template", key, step.alias("step"))
        tree = tree.join(branch, ["host", "template", key]).withColumn("template", F.concat("template", F.lit("/"), "step")).drop("step")
    leaf = tree.groupBy("host", "template").agg(F.sum("lab").alias("t_lab"), F.sum("bad").alias("t_bad"))
    hosts = tree.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("bad").alias("h_bad"))
    at_host = (F.col("h_bad") + STRENGTH * PRIOR) / (F.col("h_lab") + STRENGTH)
    purity = (F.col("t_bad") + STRENGTH * at_host) / (F.col("t_lab") + STRENGTH)
    leaf = leaf.join(hosts, "host").select("host", "template", purity.alias("blocked_share"))
    return tree.join(leaf, ["host", "template"]).select("host", *keys, "template", "blocked_share")


def judged_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, template, blocked_share.

    The verdict is the longest fitting rule's, else block if the template's smoothed share of blocked
    labels is at least THRESHOLD. A null url or one without ``://`` has an empty host and path and is a
    template of its own. Repeated rows are judged alike; an empty table gives no rows; other columns are
    ignored.
    """
    found = templates(plain(pages, id=id_col, url=url_col), "url", rules)
    keys = ["host", *[f"s{i + 1}" for i in range(DEPTH)]]
    scored = found.join(template_tree(found), keys, "left")
    verdict = F.when(F.col("hit").isNotNull(), F.substring_index("hit", ":", 1)).when(F.col("blocked_share") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    rule = F.when(F.col("hit").isNotNull(), F.substring_index("hit", ":", -1))
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", F.round("blocked_share", 6).alias("blocked_share"))
