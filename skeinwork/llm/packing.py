"""Best-fit packing of tokenised documents into sequences.

Documents are tokenised once, whole. Pieces of at most ``capacity`` tokens are dealt into groups of
about ``group_sequences`` sequences, and each group is packed by bounded-space best-fit: a fixed
number of open bins, kept in a bitset keyed by free space. A piece goes to the fullest bin it fits in;
if it fits in none, a bin is opened, and if all are open the fullest closes first. A group's pieces
arrive longest first. Only placements (no token ids) are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.shared import cut, plain
from skeinwork.llm.word_tokens import WordTokenizer

CAPACITY = 4096
OPEN_BINS = 256
GROUP_SEQUENCES = 512
END_ID = 1


class OpenBins:
    """At most ``limit`` open bins, with a bitset of the amounts of free space that some bin has."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.open, self.next = capacity, limit, 0, 0
        self.bits = 0
        self.at: dict[int, list[int]] = {}

    def _put(self, free: int, bin_id: int) -> None:
        self.at.setdefault(free, []).append(bin_id)
        self.bits |= 1 << free

    def _take(self, free: int) -> int:
        bins = self.at[free]
        bin_id = bins.pop()
        if not bins:
            del self.at[free]
            self.bits &= ~(1 << free)
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            bin_id, free = self.next, self.capacity
            self.next += 1
            self.open += 1
        if free > length:
            self._put(free - length, bin_id)
        else:
            self.open -= 1
        return bin_id, self.capacity - free


def pack(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    """Bin and offset of each length, in the order given."""
    bins = OpenBins(capacity, open_bins)
    return [bins.place(n) for n in lengths]


def tokenised_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids of every piece; null text is just the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer(tokenizer_file)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            keys, held = batch.column("id").to_pylist(), 0
            for key, ids in zip(keys, encoder.encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, value in zip(rows, (key, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32))):
                        column.append(value)
                held += len(ids)
                if held > 4_000_000:
                    yield _batch(rows, with_ids)
                    rows, held = ([], [], [], [], [], []), 0
            yield _batch(rows, with_ids)

    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return plain(docs, id=id_col, text=text_col).mapInArrow(run, schema)


def _batch(rows: tuple[list, ...], with_ids: bool) -> pa.RecordBatch:
    kinds = {"id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in list(zip(rows, kinds.values()))[: 5 + with_ids]], names=list(kinds)[: 5 + with_ids])


def packed(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """``pieces`` (id, piece, start, length, ...) with sequence_id and offset.

    The number of groups follows the number of tokens, so a task packs a bounded number of pieces of any
    corpus. Pieces of equal length are ordered by id and piece.
    """
    total = pieces.agg(F.sum("length").alias("n")).first()["n"] or 0
    groups = max(1, round(total / capacity / group_sequences))
    columns = [f.name for f in pieces.schema]

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable")
        spots = pack(rows["length"].tolist(), capacity, open_bins)
        rows["sequence_id"] = np.array([b for b, _ in spots], np.int64) + rows["group"].to_numpy(np.int64) * 2**32
        rows["offset"] = np.array([o for _, o in spots], np.int64)
        return rows.drop(columns="group")

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(place, schema).select(*columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents over ``capacity`` tokens are cut. Null and empty texts are one end id; repeated rows are
    packed as often as they come; an empty table gives no rows; other columns are ignored.
    """
    pieces = cut(tokenised_pieces(docs, tokenizer_file, capacity, id_col=id_col, text_col=text_col, with_ids=False), "pieces")
    return packed(pieces, capacity, open_bins).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id and its token ids in order of offset; ``pieces`` with their ids, of distinct documents."""
    both = placed.select("id", "piece", "sequence_id", "offset").join(pieces.select("id", "piece", "ids"), ["id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
