"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records are hashed by id into thousands of slots that never change. Bytes are summed per slot, and a
map from slot to shard is stored per version. Rebalancing edits the map: it moves as few slots as it
takes to bring every shard near the mean. The map has one row per slot (a fixed, small number), so it
is made on the driver and broadcast.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.llm.shared import cut, plain, shared_folder

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: ``shard_of[slot]``."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    def save(self, spark: SparkSession, folder: str) -> str:
        """Store this version beside the earlier ones."""
        path = f"{folder}/version={self.version}"
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> "SlotMap":
        rows = spark.read.parquet(f"{folder}/version={version}").orderBy("vslot").collect()
        return SlotMap(version, rows[0].n_shards if rows else 0, tuple(r.shard for r in rows))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(slot, shard, self.n_shards) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "vslot int, shard int, n_shards int")


def balanced(sizes: list[int], n_shards: int) -> SlotMap:
    """Version 1: the largest slot goes to the lightest shard, in descending order of bytes."""
    load = [(0, 0, shard) for shard in range(n_shards)]
    shard_of = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        weight, count, shard = heapq.heappop(load)
        shard_of[slot] = shard
        heapq.heappush(load, (weight + sizes[slot], count + 1, shard))
    return SlotMap(1, n_shards, tuple(shard_of))


def rebalanced(old: SlotMap, sizes: list[int], n_shards: int, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots leave removed shards and overfull ones, largest first that still fits, and nothing else moves."""
    shard_of, mean = list(old.shard_of), sum(sizes) / n_shards
    load = [0] * n_shards
    for slot, shard in enumerate(shard_of):
        if shard < n_shards:
            load[shard] += sizes[slot]
    loose = [slot for slot, shard in enumerate(shard_of) if shard >= n_shards]
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        shard = shard_of[slot]
        if shard < n_shards and load[shard] - sizes[slot] >= mean * (1 - tolerance) and load[shard] > mean * (1 + tolerance):
            load[shard] -= sizes[slot]
            loose.append(slot)
    lightest = [(load[shard], shard) for shard in range(n_shards)]
    heapq.heapify(lightest)
    moved = []
    for slot in sorted(loose, key=lambda s: (-sizes[s], s)):
        weight, shard = heapq.heappop(lightest)
        if shard != shard_of[slot]:
            moved.append(slot)
        shard_of[slot] = shard
        heapq.heappush(lightest, (weight + sizes[slot], shard))
    return SlotMap(old.version + 1, n_shards, tuple(shard_of), tuple(sorted(moved)))


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32 and vslot of each row; null text has no bytes."""
    text = F.coalesce("text", F.lit(""))
    return plain(docs, id=id_col, text=text_col).select(
        "id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("crc"),
        F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: at most ``slots`` numbers reach the driver."""
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r.vslot], counts[r.vslot] = r["size"], r["n"]
    return sizes, counts


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Assign every row a shard and a place in it.

    Law ``bytes``: sizes of shards are near equal. The place (``slot``) runs from 0 without gaps in each
    shard, ordered by virtual slot, then id. Null text has size 1; null ids share one virtual slot; repeated
    rows each get a place; an empty table gives no rows. The map is stored under ``folder``.
    """
    import uuid

    spark = docs.sparkSession
    rows = cut(slotted(docs, id_col, text_col, slots), "slotted")
    sizes, counts = slot_loads(rows, slots)
    slot_map = balanced(sizes, n_shards)
    slot_map.save(spark, folder or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")
    filled, places = [0] * n_shards, []
    for vslot, at in enumerate(slot_map.shard_of):
        places.append((vslot, at, filled[at]))
        filled[at] += counts[vslot]
    where = spark.createDataFrame(places, "vslot int, shard int, before long")
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col("id").asc_nulls_last(), "crc", "size"))
    placed = rows.withColumn("inside", inside).join(F.broadcast(where), "vslot")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("inside") - 1).alias("slot"), F.col("vslot").alias("virtual_slot")), slot_map
