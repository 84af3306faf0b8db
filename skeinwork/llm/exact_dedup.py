"""Exact deduplication by a tree merge of sorted digest runs.

Records are dealt into ``fan_in ** rounds`` runs. Each run is sorted by digest and reduced to one
entry per digest: count and best copy. In each round the runs of ``fan_in`` partners are merged
(entries of equal digest meet, hash-split by digest so that no task holds a whole run) and the best
copy and the sum are kept, until one logical run is left. The verdict then goes down the same tree,
only for digests with two or more copies. A digest has at most one entry per run, so a group with a
third of all rows stays spread over all runs in the first and last step.

Two entries merge only if SHA-256, a second 64-bit hash and the normalised byte length all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.shared import cut, plain, shuffle_partitions

KEY = ["sha", "chk", "nb"]


def without_spaces(text: Column) -> Column:
    """``text`` without the characters 0x20 and 0x09 to 0x0D."""
    for code in (0x20, *range(0x09, 0x0E)):
        text = F.replace(text, F.lit(chr(code)), F.lit(""))
    return text


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, rounds: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. The row with the most code points stays, then
    the smallest id. Null text counts as empty; all-empty texts form one group. A null id sorts last.
    Of rows that repeat an id and a text exactly one is kept. Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    if rounds is None:
        rounds = 1
        while fan_in**rounds < max(256, shuffle_partitions(spark)):
            rounds += 1
    text = F.coalesce(F.col("text"), F.lit(""))
    leaf = cut(
        plain(docs, id=id_col, text=text_col)
        .select("id", F.length(text).alias("chars"), without_spaces(text).alias("norm"))
        .select(
            "id",
            "chars",
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.xxhash64("norm").alias("chk"),
            F.octet_length("norm").alias("nb"),
            F.pmod(F.xxhash64("id"), F.lit(fan_in**rounds)).cast("long").alias("run"),
        ),
        "digest-runs",
    )
    best = F.struct((-F.col("chars")).alias("neg"), F.col("id").isNull().alias("last"), F.col("id").alias("id"))
    levels = [leaf.groupBy("run", *KEY).agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))]
    for _ in range(rounds):
        up = F.floor(F.col("run") / fan_in).cast("long")
        levels.append(levels[-1].withColumn("run", up).groupBy("run", *KEY).agg(F.sum("n").alias("n"), F.min("best").alias("best")))
    verdict = levels[-1].filter("n > 1").select("run", *KEY, F.col("n").alias("size"), F.col("best.id").alias("keep"))
    for level in reversed(levels[:-1]):
        below = level.select(F.col("run").alias("child"), F.floor(F.col("run") / fan_in).cast("long").alias("run"), *KEY)
        verdict = below.join(verdict, ["run", *KEY]).select(F.col("child").alias("run"), *KEY, "size", "keep")
    found = leaf.join(verdict, ["run", *KEY], "left")
    first = F.row_number().over(Window.partitionBy("run", *KEY, "id").orderBy(F.desc("chars")))
    alone = F.col("size").isNull()
    return found.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        ((alone | F.col("keep").eqNullSafe(F.col("id"))) & (first == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    names = docs.columns
    stays = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(without_spaces(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 256)
    found = docs.withColumn("__own_sha", sha).withColumn("__chars", F.length(F.col(f"`{text_col}`")))
    found = found.join(stays, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own_sha") == F.col("__sha")))
    nth = F.row_number().over(Window.partitionBy(id_col, "__own_sha").orderBy(F.desc_nulls_last("__chars")))
    return found.withColumn("__nth", nth).filter("__nth = 1").select(*[F.col(f"`{c}`") for c in names])
