"""Exact Jaccard self-join on word shingles with connected components.

1. One pass over the texts gives each document's set size and signature, and a fixed-size sketch of
   shingle frequencies. Documents with equal sets are one class; copies never meet each other again.
   A class has a number of its own, so rows without an id, or that repeat one, take part like others.
2. A second pass orders each set rare-first by that sketch and keeps the prefix that every linked pair
   must share (prefix filter), with counts of the set over hash ranges, a range for about four shingles
   (suffix filter: the sum of the counts' differences is at most the symmetric difference).
3. Candidates share a prefix shingle and pass the length and positional filters. First every class meets
   the leader of its shingles' lists (a star, linear in the list), is verified, and components form. Then
   only pairs across components are left, in lists that still hold several. A task looks at whole lists (long ones
   in blocks), applies all filters, and hands on a spanning forest over the list's components, the likeliest pairs first,
   and so many pairs more. Those are verified, components grow, and the next round allows eight times as many
   more, until no list has a pair across components that wasn't verified. So what is emitted in a round is linear in
   the lists, and no pair that could join two components is left out.
4. A pair is verified once, on the whole sets.
5. Links are counted, if asked for, inside the components, as no link leaves one: a component's classes are dealt over
   blocks of bounded size, and a task compares two blocks whole. Pairs are never rows, so a large component costs
   rows in proportion to its blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.components import components
from skeinwork.llm.shared import cut, plain, shuffle_partitions
from skeinwork.llm.words import chunks, mixed, shingle_sets, texts

SKETCH_BITS = 22
SKETCH_PARTS = 64
#: Hash ranges of the suffix filter, least and most; both are powers of two.
RANGES = 64
MOST_RANGES = 4096
#: Members of a block of a list.
LIST_BLOCK = 1024
#: Long lists are broadcast, with their numbers of blocks, up to this number.
BROADCAST_LISTS = 100_000
#: Pairs that a list hands on in the first round for each member, besides its forest.
MORE = 2
#: Pairs of a list's members that are looked at in one go.
PAIRS = 1 << 19
BLOOM_BITS = 1 << 24
#: Classes and shingles of a block, about: classes are dealt by hash.
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1 << 20
#: A shingle goes into the matrix product if its pairs are at least one in so many of the block's.
DENSE = 50
ROUND_PAIRS = 1 << 22


_NO_ID = np.iinfo(np.int64).max


def _name() -> Column:
    """A document's name: its id, or the largest number, and the hash of its text."""
    return F.struct(F.coalesce("id", F.lit(_NO_ID)).alias("k"), F.col("t"))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows' id and t (a hash of the text), their shingles, and where each row's shingles begin."""
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        keys = batch.select(["id", "t"])
        for a, b in chunks(offsets):
            lo, hi = offsets[a], offsets[b]
            found, at = shingle_sets(data[lo:hi], offsets[a : b + 1] - lo, width)
            yield keys.slice(a, b - a), found, at


def _per_set(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def _signatures(found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _per_set(mixed(found ^ np.uint64(0xA5A5A5A5)), at).view(np.int64), _per_set(mixed(found + np.uint64(0x51ED27)), at).view(np.int64)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Rows with ``part`` null: id, t, n, sig_a, sig_b of a document. Others: a task's counts for a part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["id", "t", "n", "sig_a", "sig_b", "part", "counts"]
        for keys, found, at in _sets(batches, width):
            np.add.at(counts, (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            a, b = _signatures(found, at)
            none = len(keys)
            yield pa.RecordBatch.from_arrays([keys.column("id").cast(pa.int64()), keys.column("t"), pa.array(np.diff(at).astype(np.int64)), pa.array(a), pa.array(b), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        if counts.any():
            slices = [zlib.compress(s.tobytes(), 1) for s in np.split(counts, SKETCH_PARTS)]
            none = [pa.nulls(SKETCH_PARTS, pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(slices, pa.binary())], names=names)

    return docs.mapInArrow(run, "id long, t long, n long, sig_a long, sig_b long, part int, counts binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
            one = np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
            total[part] = total[part] + one if part in total else one
    for part, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["part", "counts"])


def frequencies(profile: DataFrame) -> np.ndarray:
    """The summed sketch: 2**SKETCH_BITS counts, whatever the input. Tasks' parts are summed in two rounds."""
    parts = profile.filter("part is not null").select("part", "counts")
    salted = parts.repartition(32, "part", F.pmod(F.xxhash64("counts"), F.lit(4)))
    once = salted.mapInArrow(_summed, "part int, counts binary")
    rows = once.repartition(8, "part").mapInArrow(_summed, "part int, counts binary").collect()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint32)
    for r in rows:
        out[r.part] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return np.minimum(out.reshape(-1), 65535).astype(np.uint16)


def need(n: np.ndarray | Column, percent: int):
    """Least overlap of a set of ``n`` with any set it links to."""
    return (percent * n + 99) // 100


def prefixes(docs: DataFrame, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """id, t, n, sig_a, sig_b, prefix (rare first) and ranges (the number of shingles in each range of their hashes, modulo 16, two in a byte)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    # counts up to the sketch's usual level say nothing about a shingle
    level = int(np.median(sketch[sketch > 0])) if sketch.any() else 0
    level += 3 * int(level**0.5) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for keys, found, at in _sets(batches, width):
            sizes = np.diff(at)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            common = np.maximum(counts[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64) - level, 0)
            order = np.lexsort((found, common, rows))
            length = np.where(sizes > 0, sizes - need(sizes, percent) + 1, 0)
            place = np.arange(len(found)) - np.repeat(at[:-1], sizes)
            prefix = found[order][place < np.repeat(length, sizes)].view(np.int64)
            many = _ranges(sizes)
            upto = np.concatenate([[0], np.cumsum(many)])
            cell = upto[rows] + (found & (many[rows] - 1).astype(np.uint64)).astype(np.int64)
            counts_in = (np.bincount(cell, minlength=int(upto[-1])) & 15).astype(np.uint8)
            ranges = (counts_in[0::2] | (counts_in[1::2] << 4)).tobytes()
            a, b = _signatures(found, at)
            ends = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            counts_of = pa.array([ranges[x:y] for x, y in zip((upto[:-1] // 2).tolist(), (upto[1:] // 2).tolist())], pa.binary())
            columns = [keys.column("id").cast(pa.int64()), keys.column("t"), pa.array(sizes.astype(np.int64)), pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(prefix)), counts_of], names=["id", "t", "n", "sig_a", "sig_b", "prefix", "ranges"])

    return docs.mapInArrow(run, "id long, t long, n long, sig_a long, sig_b long, prefix array<long>, ranges binary")


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """The number of hash ranges for sets of these sizes."""
    power = np.ceil(np.log2(np.maximum(sizes, 4) / 4)).astype(np.int64)
    return np.clip(1 << power, RANGES, MOST_RANGES)


def _most_apart(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two linked sets of these sizes."""
    least = -(-percent * (na + nb) // (100 + percent))
    return na + nb - 2 * least


def _folded(ranges: list[bytes], many: int) -> np.ndarray:
    """Counts modulo 16 over ``many`` hash ranges, of sets with as many or more."""
    out = np.zeros((len(ranges), many), np.uint8)
    for i, r in enumerate(ranges):
        packed = np.frombuffer(r, np.uint8)
        out[i] = np.stack([packed & 15, packed >> 4], axis=1).reshape(-1, many).sum(axis=0, dtype=np.uint8)
    return out & 15


def _passes(percent: int) -> Column:
    """Length and positional filter of a row with na, pa, nb, pb."""
    least = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (left >= least)


def _suffix_filtered(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs whose counts over hash ranges differ by no more than linked sets can."""
    sides = {s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("ranges").alias(f"r{s}")) for s in "ab"}
    both = pairs.select("a", "b").join(sides["b"], "b").join(sides["a"], "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = _near(batch.column("ra").to_pylist(), batch.column("rb").to_pylist(), np.arange(len(na)), np.arange(len(na)), _most_apart(na, nb, percent))[0]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _near(left: list[bytes], right: list[bytes], x: np.ndarray, y: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (left[x], right[y]) have counts that differ by ``most`` at most, and by how much those differ.

    Modulo 16 the difference of two counts is the smaller way round, which is never above the true one.
    All are compared over the fewest ranges first; those that remain over the ranges that both have.
    """
    apart = np.zeros(len(x), np.int64)
    keep = np.ones(len(x), bool)
    wide_l, wide_r = 2 * np.array([len(r) for r in left], np.int64), 2 * np.array([len(r) for r in right], np.int64)
    both = np.minimum(wide_l[x], wide_r[y])
    for many in [RANGES, *(m for m in np.unique(both).tolist() if m > RANGES)]:
        some = np.flatnonzero(keep & ((both == many) if many > RANGES else True))
        if not len(some):
            continue
        used_l, at_l = np.unique(x[some], return_inverse=True)
        used_r, at_r = np.unique(y[some], return_inverse=True)
        of_l, of_r = _folded([left[i] for i in used_l.tolist()], many), _folded([right[i] for i in used_r.tolist()], many)
        step = max(1, (1 << 22) // many)
        for lo in range(0, len(some), step):
            way = (of_l[at_l[lo : lo + step]] - of_r[at_r[lo : lo + step]]) & 15
            apart[some[lo : lo + step]] = np.minimum(way, 16 - way).sum(axis=1, dtype=np.int64)
        keep[some] = apart[some] <= most[some]
    return keep, apart


def _involved(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the texts wanted, of a fixed size; where it is full it lets all pass and the join decides."""
    ids = wanted.select(F.col("t").alias("id"))
    bit = F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS))
    rows = ids.select(F.floor(bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {BLOOM_BITS}) % 64 as int))").alias("bit"))
    words = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _whole_sets(docs: DataFrame, width: int, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rep, shingles) of the classes in ``nodes`` (rep)."""
    wanted = cut(reps.select("rep", "n", "sig_a", "sig_b", "least.t").join(nodes.distinct(), "rep", "left_semi"), "wanted-classes")
    shared = docs.sparkSession.sparkContext.broadcast(_involved(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = batch.column("bit").to_numpy(zero_copy_only=False)
                keep = (shared.value[bit // 64] >> (bit % 64)) & 1 == 1
                if keep.any():
                    yield batch.filter(pa.array(keep))

        for keys, found, at in _sets(some(), width):
            a, b = _signatures(found, at)
            _, one = np.unique(np.stack([a, b, np.diff(at)]), axis=1, return_index=True)  # copies are one
            columns = [keys.column("t"), pa.array(np.diff(at).astype(np.int64)), pa.array(a), pa.array(b), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "n", "sig_a", "sig_b", "shingles"]).take(pa.array(np.sort(one)))

    rows = docs.withColumn("bit", F.pmod(F.xxhash64("t"), F.lit(BLOOM_BITS)))
    sets = rows.mapInArrow(run, "t long, n long, sig_a long, sig_b long, shingles array<long>")
    return sets.join(wanted, ["t", "n", "sig_a", "sig_b"]).select("rep", "shingles").dropDuplicates(["rep"])


def verified(docs: DataFrame, width: int, percent: int, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of different classes that link, each compared once on its whole sets."""
    sets = cut(_whole_sets(docs, width, reps, pairs.select(F.explode(F.array("a", "b")).alias("rep"))), "shingle-sets")
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    both = pairs.join(b, "b").join(a, "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _joined(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' profiles, the classes of equal sets, and (node, component) of the classes that link with others."""
    profile = cut(profiles(rows, width), "shingle-profiles")
    found = prefixes(rows, width, percent, frequencies(profile)).filter("n > 0")
    classes = found.groupBy("sig_a", "sig_b", "n").agg(F.min(_name()).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges"))
    reps = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "shingle-classes")
    posting = reps.filter(F.size("prefix") > 0).select("rep", "n", F.posexplode("prefix").alias("pos", "tok"))

    # stars: each class meets the leader of the rarest shared shingle
    lead = posting.groupBy("tok").agg(F.min(F.struct("pos", "rep", "n")).alias("lead"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    met = posting.join(lead, "tok").filter("rep <> lead.rep")
    met = met.select(F.col("lead.rep").alias("a"), F.col("lead.n").alias("na"), F.col("lead.pos").alias("pa"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    stars = met.filter(_passes(percent)).groupBy("b").agg(F.min(F.struct("pb", "pa", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    stars = cut(_suffix_filtered(stars, reps, percent), "star-pairs")
    links = cut(verified(rows, width, percent, reps, stars), "star-links")
    part = cut(components(links), "star-components")

    # across components: every other pair that could still join two of them
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    component = F.coalesce("component", "rep").alias("component")
    lists = _mixed_lists(posting.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("tok", "rep", "n", "pos", component))
    lists = cut(lists.join(reps.select("rep", "ranges"), "rep"), "mixed-lists")
    open_lists, more = lists, MORE
    while True:
        found = cut(across(open_lists, percent, more), "pairs-across")
        again = cut(found.filter("tok is not null").select("tok").distinct(), "open-lists")
        pairs = cut(found.filter("tok is null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "new-pairs")
        if pairs.limit(1).count():
            grown = cut(verified(rows, width, percent, reps, pairs), "new-links")
            if grown.limit(1).count():
                # a component is a star already
                part = cut(components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(grown)), "components")
        if not again.limit(1).count():
            return profile, reps, part
        # lists that kept pairs back; all pairs of the others are verified
        tried = tried.union(pairs)
        open_lists = lists.drop("component").join(again, "tok", "left_semi").join(part.withColumnRenamed("node", "rep"), "rep", "left")
        open_lists = cut(_mixed_lists(open_lists.select("tok", "rep", "n", "pos", component, "ranges")), "mixed-lists")
        more *= 8


def _mixed_lists(at: DataFrame) -> DataFrame:
    """The rows of lists with more than one component, with their component."""
    lists = at.groupBy("tok").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return at.join(lists.select("tok"), "tok", "left_semi")


def across(lists: DataFrame, percent: int, more: int) -> DataFrame:
    """(a, b), a < b: of each list (tok, rep, n, pos, component, ranges) pairs of different components that pass all filters.

    These are a spanning forest over the list's components and up to ``more`` pairs a member, the likeliest first; a row with
    ``tok`` tells that a list has others. A long list's largest component and the others' members are dealt over blocks, and a
    task sees two blocks, one of them not of the largest component.
    """
    long = lists.groupBy("tok").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > LIST_BLOCK).select("tok")
    counts = lists.select("tok", "component").join(long, "tok", "left_semi").groupBy("tok", "component").agg(F.count(F.lit(1)).alias("many"))
    sizes = counts.groupBy("tok").agg(F.sum("many").alias("all"), F.max(F.struct("many", "component")).alias("main"))
    blocks = lambda many: F.ceil(many / F.lit(LIST_BLOCK)).cast("int")
    sizes = cut(sizes.select("tok", F.col("main.component").alias("main"), blocks(F.col("all") - F.col("main.many")).alias("others"), blocks(F.col("main.many")).alias("mains")), "long-lists")
    at = lists.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LISTS else sizes, "tok", "left")
    own = F.when(F.col("component") == F.col("main"), F.col("others") + F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("others"))).cast("int")
    at = at.withColumn("own", own)
    partners = F.when(F.col("own") >= F.col("others"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.array_except(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1), F.array("own")))
    at = at.select("tok", "rep", "n", "pos", "component", "ranges", F.coalesce("own", F.lit(0)).alias("own"), F.explode(F.when(F.col("main").isNull(), F.array(F.lit(1))).otherwise(partners)).alias("other"))
    at = at.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    at = at.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= 16 * LIST_BLOCK:  # all but the last cell, which may go on
                whole = pa.concat_batches(held)
                edge = np.flatnonzero(_steps(*(whole.column(c).to_numpy() for c in ("tok", "i", "j"))))
                last = int(edge[-1])
                if last:
                    yield _forests(whole.slice(0, last), percent, more)
                held, rows = [whole.slice(last)], len(whole) - last
        if rows:
            yield _forests(pa.concat_batches(held), percent, more)

    return at.mapInArrow(run, "a long, b long, tok long")


def _steps(*keys: np.ndarray) -> np.ndarray:
    """Which rows begin a run of equal keys."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return fresh


def _forests(cells: pa.RecordBatch, percent: int, more: int) -> pa.RecordBatch:
    """The pairs that ``across`` hands on, of whole cells (tok, i, j)."""
    tok, rep, n, pos, component, own, i, j = (cells.column(c).to_numpy().astype(np.int64) for c in ("tok", "rep", "n", "pos", "component", "own", "i", "j"))
    ranges = cells.column("ranges").to_pylist()
    begin = np.flatnonzero(_steps(tok, i, j))
    sizes = np.diff(np.append(begin, len(tok)))
    cell = np.repeat(np.arange(len(begin)), sizes)
    later = np.repeat(begin + sizes, sizes) - 1 - np.arange(len(tok))  # the members of the cell after a member
    upto = np.concatenate([[0], np.cumsum(later)])
    xs, ys, far = [], [], []
    lo = 0
    while lo < len(tok):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        x = np.repeat(np.arange(lo, hi), later[lo:hi])
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[lo:hi] - upto[lo], later[lo:hi])
        # pairs inside a block belong to one cell of it, with the next block
        ok = (component[x] != component[y]) & ((own[x] != own[y]) | ((own[x] == i[x]) & (j[x] == i[x] + 1)))
        x, y = x[ok], y[ok]
        na, nb = n[x], n[y]
        least = -(-percent * (na + nb) // (100 + percent))
        ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - pos[x], nb - pos[y]) >= least)
        x, y = x[ok], y[ok]
        ok, apart = _near(ranges, ranges, x, y, _most_apart(n[x], n[y], percent))
        xs.append(x[ok])
        ys.append(y[ok])
        far.append(apart[ok] / (n[x[ok]] + n[y[ok]]))
        lo = hi
    x, y, far = np.concatenate(xs), np.concatenate(ys), np.concatenate(far)
    order = np.lexsort((y, x, far, cell[x]))
    x, y = x[order], y[order]
    a, b = np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])
    chosen = np.zeros(len(x), bool)
    root: dict[tuple[int, int], int] = {}

    def top(c: int, k: int) -> int:
        while (up := root.get((c, k), k)) != k:
            root[c, k] = root.get((c, up), up)
            k = up
        return k

    for k, (c, p, q) in enumerate(zip(cell[x].tolist(), component[x].tolist(), component[y].tolist())):
        p, q = top(c, p), top(c, q)
        if p != q:
            root[c, p] = q
            chosen[k] = True
    nth = np.cumsum(~chosen)
    start = np.flatnonzero(_steps(cell[x])) if len(x) else np.zeros(0, np.int64)
    before = np.repeat(nth[start] - ~chosen[start], np.diff(np.append(start, len(x))))
    chosen |= nth - before <= more * sizes[cell[x]]
    back = np.unique(tok[x[~chosen]])
    none = np.zeros(len(back), np.int64)
    of_list = np.concatenate([np.zeros(int(chosen.sum()), bool), np.ones(len(back), bool)])
    columns = [pa.array(np.concatenate([c[chosen], none]), mask=of_list) for c in (a, b)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([np.zeros(int(chosen.sum()), np.int64), back]), mask=~of_list)], names=["a", "b", "tok"])


def _per_row(profile: DataFrame, reps: DataFrame, joined: DataFrame) -> DataFrame:
    """id, t, n, least (the first name of the component) and what ``reps`` has besides, null for a text that is alone."""
    named = reps.drop("prefix", "ranges").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    first = named.filter("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    large = named.filter("copies > 1 or component is not null").join(first, "component", "left").withColumn("least", F.coalesce("first", "least")).drop("rep", "component", "first")
    rows = profile.filter("part is null").select("id", "t", "n", "sig_a", "sig_b").join(large, ["sig_a", "sig_b", "n"], "left")
    return rows.withColumn("least", F.coalesce("least", _name()))


def _component() -> Column:
    return F.nullif(F.col("least.k"), F.lit(_NO_ID)).alias("component_id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets. A row without words
    (null or empty text) has no shingles and links with nothing. Rows are told apart by their texts, so rows that repeat an
    id each link as their texts do, and so do rows without an id; a component without any id is null. An empty table
    gives no rows; other columns are ignored.
    """
    found = _per_row(*_joined(_rows(docs, id_col, text_col), width, percent))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), _component())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return plain(docs, id=id_col, text=text_col).withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``jaccard_components`` with n_links, the number of other rows that a row links with, equal texts included."""
    rows = _rows(docs, id_col, text_col)
    profile, reps, joined = _joined(rows, width, percent)
    far = cut(_links_inside(rows, reps, joined, width, percent), "links-inside")
    found = _per_row(profile, reps.join(far, "rep", "left"), joined)
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("far", F.lit(0)), F.lit(0)).cast("long")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), _component(), n_links.alias("n_links"))


def _links_inside(rows: DataFrame, reps: DataFrame, joined: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, far): how many rows of other classes a class links with."""
    members = reps.join(joined.withColumnRenamed("node", "rep"), "rep").select("rep", "n", "copies", "component")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).cast("int")
    dealt = members.join(members.groupBy("component").agg(blocks.alias("blocks")), "component")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("n")
    sets = _whole_sets(rows, width, reps, joined.select(F.col("node").alias("rep")))
    met = dealt.join(sets, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "shingles")
    met = met.repartition(shuffle_partitions(rows.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("component", "i", "j")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi > lo:
                    if held and keys[lo].tolist() != key:
                        out.append(_counted(held, percent))
                        held = []
                    key = keys[lo].tolist()
                    held.append(batch.slice(lo, hi - lo))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rep", "far"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _counted(held, percent)], names=["rep", "far"])

    return met.mapInArrow(run, "rep long, far long").groupBy("rep").agg(F.sum("far").alias("far"))


def _counted(held: list[pa.RecordBatch], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of two blocks (or of one with itself) and how many rows of the other block each links with."""
    rep, copies, block = (np.concatenate([b.column(c).to_numpy().astype(np.int64) for b in held]) for c in ("rep", "copies", "block"))
    sizes = np.concatenate([np.diff(b.column("shingles").offsets.to_numpy()) for b in held]).astype(np.int64)
    tokens = np.concatenate([b.column("shingles").flatten().to_numpy() for b in held])
    one = held[0].column("i")[0].as_py() == held[0].column("j")[0].as_py()
    n_a = len(rep) if one else int((block == block[0]).sum())
    if not one and block[0] == block[-1]:  # the other block is empty
        return rep, np.zeros(len(rep), np.int64)
    shared = overlaps(tokens, np.repeat(np.arange(len(rep)), sizes), len(rep), n_a)
    of_b = slice(0 if one else n_a, None)
    links = 100 * shared >= percent * (sizes[:n_a, None] + sizes[of_b] - shared)
    if one:
        np.fill_diagonal(links, False)
        return rep, links @ copies
    return rep, np.concatenate([links @ copies[of_b], copies[:n_a] @ links])


def overlaps(tokens: np.ndarray, owners: np.ndarray, n: int, n_a: int) -> np.ndarray:
    """|intersection| of each of the first ``n_a`` sets with each of the rest, or of all with all if n_a is n.

    Shingles of many pairs go through matrix products, those of few through their lists.
    """
    base = 0 if n_a == n else n_a
    n_b = n - base
    _, tokens = np.unique(tokens, return_inverse=True)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    a, b = owners < n_a, owners >= base
    p, q = (np.bincount(tokens[x], minlength=int(tokens[-1]) + 1 if len(tokens) else 0) for x in (a, b))
    often, some = p * q * DENSE >= n_a * n_b, (p > 0) & (q > 0)
    out = np.zeros((n_a, n_b), np.int64)
    place = np.cumsum(often & some) - 1
    keep = (often & some)[tokens]
    at, who = place[tokens[keep]], owners[keep]
    step = max(2048, ROUND_PAIRS // n)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        x, y = np.searchsorted(at, [lo, lo + step])
        grid = np.zeros((n, step), np.float32)
        grid[who[x:y], at[x:y] - lo] = 1
        out += (grid[:n_a] @ grid[base:].T).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(q)])
    of_b = owners[b] - base
    rare = a & (some & ~often)[tokens]
    row, tok = owners[rare], tokens[rare]
    upto = np.concatenate([[0], np.cumsum(q[tok])])
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + ROUND_PAIRS, "right")) - 1)
        many = q[tok[lo:hi]]
        inner = np.arange(upto[hi] - upto[lo]) - np.repeat(upto[lo:hi] - upto[lo], many)
        pair = np.repeat(row[lo:hi], many) * n_b + of_b[np.repeat(first[tok[lo:hi]], many) + inner]
        out += np.bincount(pair, minlength=n_a * n_b).reshape(n_a, n_b)
        lo = hi
    return out


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their component: by id (none is last), then by a hash of the text.

    Rows that repeat an id and a text come first or not together.
    """
    rows = _rows(docs, id_col, text_col)
    out = _per_row(*_joined(rows, width, percent)).filter(F.col("least") != _name()).select(_name().alias("name"))
    out = cut(out.select(F.col("name.k").alias("__k"), F.col("name.t").alias("__t")).distinct(), "near-copies")
    k = F.coalesce(F.col(f"`{id_col}`"), F.lit(_NO_ID))
    t = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.join(out, (k == F.col("__k")) & (t == F.col("__t")), "left_anti")
