"""Removal of repeated byte strings across documents with suffix arrays.

A string of ``length`` bytes belongs to the rarest-hash k-gram inside it (its anchor), which equal
strings share; strings in a row that share an anchor form a segment. Segments of equal anchor and bytes
are one entry. Hashes of all segments, without their bytes, meet by anchor: an entry that several ids
have is repeated as a whole, and an anchor with several entries is a block. Only the segments of blocks
are then read with their bytes. A block is dealt over as many parts as its entries need: each string
goes to the part that its bytes name, so equal strings meet whatever the number of parts; a block of few
entries has one part. Strings whose hash nothing else in the part has are certainly alone and left out.
The rest's suffix array (linear grouping, many parts at once) brings equal strings together; neighbours
are compared byte by byte, and each string gets the smallest id of its run. The ids then go back to the
segments. Only the first of equal texts takes part, as the others lose all their bytes.

Bloom filters spare reading and shuffling what surely has no partner. Their size follows the number of
keys up to MOST_BITS; where they are full, the joins decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.shared import cut, plain
from skeinwork.llm.suffix_array import suffix_arrays
from skeinwork.llm.words import chunks, mixed, range_hashes, texts

LENGTH = 50
ANCHOR = 20
#: Entries of a part of a block, about.
BLOCK = 512
PIECE = 1_000_000
#: Bytes of texts whose segments are made distinct before they are handed on.
ROUND = 2_000_000
#: Bytes whose suffixes are ordered at once.
ORDER = 500_000
#: Bytes of pieces that a task holds, besides its last part.
HELD = 12_000_000
#: Segments of a part of the hashes, about.
PART_SEGMENTS = 1_000_000
BITS_A_KEY = 10
MOST_BITS = 1 << 30
#: Cells of the table of parts; anchors that share a cell take the larger number of parts.
CELLS = 1 << 20
#: Rows that are handled at once.
ROWS = 2000
_BITS_PART = 1 << 20
_NO_ID = np.iinfo(np.int64).max


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first start, last start, anchor hash and content hash of every segment."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.arange(n - ANCHOR + 1)
    grams = range_hashes(data, at, at + ANCHOR)
    packed = (mixed(grams) & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    anchor = (_sliding_min(packed, length - ANCHOR + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = anchor[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(fresh)
    first, last = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    return row[first], first, last, grams[anchor[begin]], range_hashes(data, first, last + length)


def _pieces(batches: Iterator[pa.RecordBatch], length: int, firsts: tuple[int, np.ndarray]) -> Iterator[tuple]:
    """Whole texts of first copies in chunks; a text longer than PIECE in overlapping pieces, so that every string lies in one."""
    for whole in (batch.slice(at, ROWS) for batch in batches for at in range(0, len(batch), ROWS)):
        batch = whole.filter(pa.array(_in_bloom(firsts, whole.column("key").to_numpy())))
        data, offsets = texts(batch.column("text"))
        ids = batch.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        sigs = batch.column("sig").to_numpy(zero_copy_only=False)
        for a, b in chunks(offsets):
            lo, hi = int(offsets[a]), int(offsets[b])
            if b - a == 1 and hi - lo > PIECE:
                for at in range(lo, hi - length + 1, PIECE - length + 1):
                    to = min(hi, at + PIECE)
                    yield ids[a:b], sigs[a:b], data[at:to], np.array([0, to - at]), at - lo
            else:
                yield ids[a:b], sigs[a:b], data[lo:hi], offsets[a : b + 1] - lo, 0


def _rounds(batches: Iterator[pa.RecordBatch], length: int, firsts: tuple[int, np.ndarray], shift: int) -> Iterator[tuple[np.ndarray, ...]]:
    """id, sig, anchor (its hash without ``shift`` low bits), content hash, first start, number of starts, place and bytes of the segments of some texts."""
    held: list[tuple[np.ndarray, ...]] = []
    raws: list[bytes] = []
    size = 0
    for ids, sigs, data, offsets, at in _pieces(batches, length, firsts):
        row, first, last, h, ch = segments(data, offsets, length)
        held.append((ids[row], sigs[row], (h >> np.uint64(shift)).view(np.int64), ch.view(np.int64), first - offsets[row] + at, last - first + 1, first + size))
        raws.append(data.tobytes())
        size += len(data)
        if size >= ROUND:
            yield (*(np.concatenate(c) for c in zip(*held)), b"".join(raws))
            held, raws, size = [], [], 0
    if held:
        yield (*(np.concatenate(c) for c in zip(*held)), b"".join(raws))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the keys (the first one counts first), and where a run of equal keys begins and ends in it."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for key in keys:
        k = key[order]
        fresh[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(fresh)
    return order, begin, np.append(begin[1:], len(order))[: len(begin)]


def bloom(keys: DataFrame, key: Column) -> tuple[int, np.ndarray]:
    """The number of bits and the words of a Bloom filter over a long column; its size follows the number of rows up to MOST_BITS."""
    bits = _BITS_PART
    while bits < min(BITS_A_KEY * keys.count(), MOST_BITS):
        bits *= 2
    bit = F.pmod(key, F.lit(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, at = (batch.column(c).to_numpy() for c in ("part", "at"))
            for p in np.unique(part).tolist():
                words = held.setdefault(p, np.zeros(_BITS_PART // 64, np.int64))
                own = at[part == p].astype(np.int64)
                np.bitwise_or.at(words, own // 64, np.left_shift(np.int64(1), own % 64))
        for p, words in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["part", "words"])

    dealt = keys.select(F.floor(bit / _BITS_PART).cast("int").alias("part"), (bit % _BITS_PART).cast("int").alias("at"))
    dealt = dealt.repartition(bits // _BITS_PART, "part").mapInArrow(run, "part int, words binary")
    out = np.zeros((bits // _BITS_PART, _BITS_PART // 64), np.int64)
    for r in dealt.toLocalIterator():
        out[r["part"]] |= np.frombuffer(r["words"], np.int64)
    return bits, out.reshape(-1)


def _in_bloom(found: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    bits, words = found
    at = keys & (bits - 1)
    return (words[at // 64] >> (at % 64)) & 1 == 1


def met(rows: DataFrame, firsts: tuple[int, np.ndarray], length: int, part_bits: int) -> DataFrame:
    """h, ch, own: an entry that several ids have, with the smallest. h, many (ch null): a block with its number of entries.

    Hashes go as sorted arrays, one a task, round and part, so that a row of the shuffle holds thousands of them.
    """
    spread = rows.sparkSession.sparkContext.broadcast(firsts)
    shift = 32 - part_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, h, ch, *_rest in _rounds(batches, length, spread.value, shift):
            order, begin, _ = _runs(h, ch)
            if not len(order):
                continue
            own, top = np.minimum.reduceat(ids[order], begin), np.maximum.reduceat(ids[order], begin)
            h, ch = h[order][begin], ch[order][begin]
            two = own < top
            h, ch, ids_of = np.concatenate([h, h[two]]), np.concatenate([ch, ch[two]]), np.concatenate([own, top[two]])
            order = np.argsort(h, kind="stable")
            h, ch, ids_of = h[order], ch[order], ids_of[order]
            part = h >> 32
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            stop = np.append(edge[1:], len(part)).tolist()
            low = h.astype(np.uint32)
            blobs = [low[a:b].tobytes() + ch[a:b].tobytes() + ids_of[a:b].tobytes() for a, b in zip(edge.tolist(), stop)]
            yield pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "hashes"])

    def merged(part: int, blobs: list[bytes]) -> pa.RecordBatch:
        counts = [len(x) // 20 for x in blobs]
        h = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(blobs, counts)])
        ch = np.concatenate([np.frombuffer(x, np.int64, n, 4 * n) for x, n in zip(blobs, counts)])
        ids = np.concatenate([np.frombuffer(x, np.int64, n, 12 * n) for x, n in zip(blobs, counts)])
        order, begin, _ = _runs(h, ch)
        own, top = np.minimum.reduceat(ids[order], begin), np.maximum.reduceat(ids[order], begin)
        h, ch = h[order][begin], ch[order][begin]
        whole = own < top
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = np.diff(np.append(first, len(h)))
        blocks = (many > 1) & (np.minimum.reduceat(own, first) < np.maximum.reduceat(top, first))
        names = np.concatenate([h[whole], h[first][blocks]]).astype(np.int64) + (part << 32)
        n_whole, n_blocks = int(whole.sum()), int(blocks.sum())
        either = np.concatenate([np.zeros(n_whole, bool), np.ones(n_blocks, bool)])
        pad = np.zeros(n_blocks, np.int64)
        columns = [pa.array(np.concatenate([ch[whole], pad]), mask=either), pa.array(np.concatenate([own[whole], pad]), mask=either)]
        return pa.RecordBatch.from_arrays([pa.array(names), *columns, pa.array(np.concatenate([np.zeros(n_whole, np.int64), many[blocks]]), mask=~either)], names=["h", "ch", "own", "many"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("hashes")):
                if part != at and held:
                    yield merged(at, held)
                    held = []
                at = part
                held.append(blob.as_py())
        if held:
            yield merged(at, held)

    dealt = rows.mapInArrow(run, "part int, hashes binary").repartition(1 << part_bits, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(parts, "h long, ch long, own long, many long")


def parts_of(blocks: DataFrame, block: int) -> np.ndarray:
    """Of each cell of anchors, the largest power of two of parts that a block needs; CELLS bytes, whatever the input."""
    power = F.ceil(F.log2(F.col("many") / block)).cast("int")
    large = blocks.filter(F.col("many") > block).select(F.pmod("h", F.lit(CELLS)).cast("int").alias("cell"), power.alias("power"))
    out = np.zeros(CELLS, np.uint8)
    for r in large.groupBy("cell").agg(F.max("power").alias("power")).toLocalIterator():
        out[r["cell"]] = r["power"]
    return out


def pieces(rows: DataFrame, blocks: DataFrame, firsts: tuple[int, np.ndarray], length: int, part_bits: int, block: int = BLOCK) -> DataFrame:
    """h, part, ch, at, own, bytes: the entries of blocks, cut where their strings belong to different parts."""
    context = rows.sparkSession.sparkContext
    spread, shared, powers = context.broadcast(firsts), context.broadcast(bloom(blocks, F.col("h"))), context.broadcast(parts_of(blocks, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, h, ch, _first, n, at, raw in _rounds(batches, length, spread.value, 32 - part_bits):
            keep = np.flatnonzero(_in_bloom(shared.value, h))
            ids, h, ch, n, at = (x[keep] for x in (ids, h, ch, n, at))
            order, begin, _ = _runs(h, ch)
            if not len(order):
                continue
            one = order[begin]
            own = np.minimum.reduceat(ids[order], begin)
            h, ch, n, at = h[one], ch[one], n[one], at[one]
            entry = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
            start = at[entry] + nth
            data = np.frombuffer(raw, np.uint8)
            mask = (np.uint64(1) << powers.value[h & (CELLS - 1)].astype(np.uint64)) - np.uint64(1)
            part = (range_hashes(data, start, start + length) & mask[entry]).astype(np.int64)
            begin, content = _cut_out(raw, entry, start, part, length)
            of = entry[begin]
            columns = [pa.array(x) for x in (h[of], part[begin], ch[of], nth[begin], own[of])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary())], names=["h", "part", "ch", "at", "own", "bytes"])

    # an anchor that passed the filter by chance has strings that nothing precedes
    return rows.mapInArrow(run, "h long, part long, ch long, at long, own long, bytes binary")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _cut_out(raw: bytes, entry: np.ndarray, start: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, list[bytes]]:
    """Maximal runs of strings in a row of equal entry and key: their first strings' indexes, and the runs' bytes."""
    fresh = np.ones(len(entry), bool)
    fresh[1:] = (entry[1:] != entry[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(fresh)
    stop = start[np.append(begin[1:], len(entry))[: len(begin)] - 1] + length
    return begin, [raw[a:b] for a, b in zip(start[begin].tolist(), stop.tolist())]


def _strings(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, number in it and start of every string."""
    n = np.diff(offsets) - length + 1
    entry = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    return entry, at, offsets[entry] + at


def run_minima(data: np.ndarray, sizes: np.ndarray, block: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """For every place of the pieces' bytes, the smallest ``own`` of the pieces of its block that have the string there; else -1.

    Pieces (``sizes`` bytes each) stand one after the other and those of a block together. Strings are compared
    with their neighbours in the block's suffix array only.
    """
    entry = np.repeat(np.arange(len(sizes)), sizes)
    symbols = np.zeros(len(data) + len(sizes), np.int16)  # a 0 ends each piece
    where = np.arange(len(data)) + entry
    symbols[where] = data.astype(np.int16) + 1
    back = np.full(len(symbols), -1)
    back[where] = np.arange(len(data))
    of_blocks = np.bincount(block, weights=sizes + 1).astype(np.int64)
    ranked = back[suffix_arrays(symbols, np.concatenate([[0], np.cumsum(of_blocks)]))]
    ends = np.cumsum(sizes)
    ranked = ranked[ranked >= 0]
    ranked = ranked[ranked + length <= ends[entry[ranked]]]
    least = np.full(len(data), -1)
    if not len(ranked):
        return least
    eight = data.astype(np.uint64)  # eight bytes from each place
    for step in (1, 2, 4):
        eight = (eight[:-step] << np.uint64(8 * step)) | eight[step:]
    of = block[entry[ranked]]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = of[1:] != of[:-1]
    for at in [*range(0, length - 8, 8), length - 8]:
        here = eight[ranked + at]
        fresh[1:] |= here[1:] != here[:-1]
    begin = np.flatnonzero(fresh)
    found = np.minimum.reduceat(own[entry[ranked]], begin)
    least[ranked] = np.repeat(found, np.diff(np.append(begin, len(ranked))))
    return least


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of equal keys."""
    fresh = np.zeros(len(keys[0]), bool)
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.cumsum(fresh)


def _least(held: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """h, ch, at, least of the pieces of whole parts, which stand together."""
    h, part, ch, at, own = (held.column(c).to_numpy().astype(np.int64) for c in ("h", "part", "ch", "at", "own"))
    block = _numbered(h, part)
    # one piece of those that several tasks have
    order, begin, _ = _runs(block, ch, at)
    one, own = order[begin], np.minimum.reduceat(own[order], begin)
    held, h, ch, at, block = held.take(pa.array(one)), h[one], ch[one], at[one], block[one]
    # strings that something else in the part may equal: the others' hashes show that they are alone
    data, offsets = _bytes_of(held.column("bytes"))
    entry, nth, start = _strings(offsets, length)
    hashes, of = range_hashes(data, start, start + length), block[entry]
    order, begin, end = _runs(of, hashes)
    shared = np.repeat(np.minimum.reduceat(own[entry[order]], begin) < np.maximum.reduceat(own[entry[order]], begin), end - begin) if len(order) else np.zeros(0, bool)
    keep = np.sort(order[shared])
    entry, nth, start = entry[keep], nth[keep], start[keep]
    first, content = _cut_out(data.tobytes(), entry, start, np.zeros(len(entry), np.int64), length)
    of, nth, size = entry[first], nth[first], np.array([len(x) for x in content], np.int64)
    # equal pieces of a block are one, with the smallest id
    index: dict[tuple[int, bytes], int] = {}
    piece = np.array([index.setdefault(key, len(index)) for key in zip(block[of].tolist(), content)], np.int64)
    content, block, size = [c for _, c in index], np.array([b for b, _ in index], np.int64), np.array([len(c) for _, c in index], np.int64)
    smallest = np.full(len(index), _NO_ID)
    np.minimum.at(smallest, piece, own[of])
    # parts of like size together: each step of the ordering then has work in most of them
    total = np.bincount(block, weights=size, minlength=1)
    order = np.lexsort((block, total[block])) if len(block) else np.zeros(0, np.int64)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(index)
    upto, lo = np.cumsum(size[order]), 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ORDER)))
        while hi < len(order) and block[order[hi]] == block[order[hi - 1]]:
            hi += 1
        some = order[lo:hi]
        least = run_minima(np.frombuffer(b"".join([content[i] for i in some.tolist()]), np.uint8), size[some], _numbered(block[some]), smallest[some], length)
        places = np.cumsum(size[some]) - size[some]
        for i, a in zip(some.tolist(), places.tolist()):
            found[i] = least[a : a + len(content[i]) - length + 1]
        lo = hi
    earliest = np.array([x.min() for x in found], np.int64)
    rows = np.flatnonzero(earliest[piece] < own[of]) if len(piece) else piece
    columns = [pa.array(h[of][rows]), pa.array(ch[of][rows]), pa.array((at[of] + nth)[rows]), pa.array([found[i] for i in piece[rows].tolist()], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["h", "ch", "at", "least"])


def least_ids(dealt: DataFrame, length: int) -> DataFrame:
    """h, ch, at, least: the smallest id at which each string of an entry occurs, from string ``at`` on; only where one is below the entry's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD:  # all but the last part, which may go on
                whole = pa.concat_batches(held)
                h, part = (whole.column(c).to_numpy() for c in ("h", "part"))
                edge = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1]))
                if len(edge):
                    yield _least(whole.slice(0, int(edge[-1]) + 1), length)
                    whole = whole.slice(int(edge[-1]) + 1)
                held, size = [whole], whole.nbytes
        if held:
            yield _least(pa.concat_batches(held), length)

    blocks = dealt.repartition("h", "part").sortWithinPartitions("h", "part")
    return blocks.mapInArrow(run, "h long, ch long, at long, least array<long>")


def covered(rows: DataFrame, firsts: tuple[int, np.ndarray], length: int, part_bits: int) -> DataFrame:
    """id, sig, lo, hi: byte ranges covered by strings that also start in a document with a smaller id."""
    found = cut(met(rows, firsts, length, part_bits), "segments")
    # of an entry, all strings or, from ``at`` on, those with an earlier id
    whole = found.filter("ch is not null").select("h", "ch", F.lit(0).cast("long").alias("at"), "own", F.lit(None).cast("array<long>").alias("least"))
    dealt = pieces(rows, found.filter("ch is null").select("h", "many"), firsts, length, part_bits)
    part = cut(least_ids(dealt, length), "least-ids").select("h", "ch", "at", F.lit(None).cast("long").alias("own"), "least")
    minima = whole.unionByName(part)
    context = rows.sparkSession.sparkContext
    spread, shared = context.broadcast(firsts), context.broadcast(bloom(minima, F.expr("h ^ ch")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sigs, h, ch, first, n, _at, _raw in _rounds(batches, length, spread.value, 32 - part_bits):
            keep = np.flatnonzero(_in_bloom(shared.value, h ^ ch))
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (ids, sigs, first, n, h, ch)], names=["id", "sig", "first", "n", "h", "ch"])

    placed = rows.mapInArrow(run, "id long, sig long, first long, n long, h long, ch long").join(minima, ["h", "ch"])
    hit = F.transform("least", lambda m: m < F.col("id"))
    placed = placed.select("id", "sig", (F.col("first") + F.col("at")).alias("first"), "n", "own", hit.alias("hit"))
    placed = placed.filter("own < id or array_contains(hit, true)")
    lo = F.when(F.col("hit").isNull(), F.col("first")).otherwise(F.col("first") + F.array_position("hit", True) - 1)
    hi = F.when(F.col("hit").isNull(), F.col("first") + F.col("n") - 1).otherwise(F.col("first") + F.size("hit") - F.array_position(F.reverse("hit"), True))
    return placed.select("id", "sig", lo.alias("lo"), (hi + length).alias("hi"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for key, sig, text, spans in zip(*(batch.column(c) for c in ("id", "sig", "text", "spans"))):
            raw, kept, end, removed, runs = (text.as_py() or "").encode(), [], 0, 0, 0
            last = -1
            for span in sorted((s["lo"], s["hi"]) for s in spans.as_py()):
                lo, hi = span
                if lo > last:
                    runs += 1
                    kept.append(raw[end:lo])
                removed += max(0, hi - max(lo, end))
                end = last = max(end, hi)
            kept.append(raw[end:])
            for column, value in zip(out, (key.as_py(), sig.as_py(), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["id", "sig", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes covers it that also starts in a document with a
    smaller id, as the input has them; matches never cross documents. Null text is empty; texts shorter
    than ``length`` stay; rows that repeat an id don't cover each other; rows without an id come last
    and don't cover each other; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce("id", F.lit(_NO_ID))
    rows = plain(docs, id=id_col, text=text_col).select("id", text.alias("text"), F.xxhash64(text).alias("sig")).withColumn("key", F.xxhash64(key, "sig"))
    base = cut(rows.select("id", "sig", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "text-digests")
    copies = cut(base.groupBy("sha", "n_bytes").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("many"), F.min("sig").alias("sig")), "text-classes")
    firsts = bloom(copies, F.xxhash64("least", "sig"))
    # a segment has about nine bytes that no other of its text has
    n_segments = (copies.agg(F.sum("n_bytes")).first()[0] or 0) / 9
    part_bits = min(31, max(4, int(n_segments / PART_SEGMENTS).bit_length()))
    spans = covered(rows, firsts, length, part_bits).groupBy("id", "sig").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = cut(spans, "covered-ranges")
    touched = rows.withColumn("id", key).join(spans, ["id", "sig"]).dropDuplicates(["id", "sig"])
    cutout = touched.mapInArrow(_removed, "id long, sig long, n_removed long, n_spans long, kept_sha256 string")
    # of equal texts only the smallest id keeps its bytes, whatever else they share
    copies = copies.filter("many > 1").select("sha", "n_bytes", "least")
    found = base.withColumn("key", key).join(copies, ["sha", "n_bytes"], "left")
    found = found.join(cutout.withColumnRenamed("id", "key"), ["key", "sig"], "left")
    copy = (F.col("least") < F.col("key")) & (F.col("n_bytes") >= length)
    return found.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
