"""Sampled SentencePiece segmentations without replacement, and decoding.

A text is a chain of units (a run of space marks and the word after it, as pieces can hold several marks); a unit's lattice has an edge for every
piece of the vocabulary, weighted by a Zipf law of the piece's rank, or a chain of bytes for a character
without a piece. Backward sums over the lattice give every edge its exact probability.

Gumbel top-k: a set of segmentations is a search node with the perturbed log-probability of its best member.
The root gets a Gumbel value; sampling forward from a node gives the member that has the node's value,
and the rest of the node falls apart into one set per unit (same units before, another choice here,
anything after), whose values are Gumbels of the sets' masses below the node's value. An A-star search
pops the largest value k times; values are exact bounds, so the k texts emitted are distinct and come in the
order of their perturbed log-probabilities. The largest value left is the threshold of the inclusion
scores: 1 - exp(-exp(log_prob - threshold)). All randomness is a hash of seed, row key, round and place.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.shared import plain
from skeinwork.llm.words import mixed

MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: More at once asks for fewer lattices, as texts share units, but for more memory.
CHUNK_CHARS = 10_000_000
#: A choice whose alternatives have less mass in all is taken as certain.
CERTAIN = 1e-9
#: Rows that are handed on at once.
OUT_ROWS = 256
#: Units that are walked at once, and units of a row whose sets are looked at first.
BLOCK = 1 << 15
FIRST_SETS = 32
#: Units whose rows are searched at once.
SEARCHED = 1 << 17
#: Below it, a set would need a uniform number nearer to 1 than 53 bits can be.
_LEAST_LOG = -37.0
_TOP_BITS = 19
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _rank_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and descaling factors: the hash of values[a:b] is mixed((sums[b] - sums[a]) * down[a])."""
    n = len(values)
    up, down = np.full(n, _M, np.uint64), np.full(n + 1, _M_INV, np.uint64)
    up[:1] = down[:1] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(values.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up), out=sums[1:])
    return sums, np.multiply.accumulate(down)


class Vocabulary:
    """Pieces of a SentencePiece model file, by hash; byte pieces apart."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usual = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in usual]
        #: A piece with a mark after something else could cross from one unit to the next; then a text is one unit.
        self.crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        rank = np.array([min(-model.get_score(i), size) for i in usual])
        norm = np.log(np.log(size))
        weight = -np.log(rank + 3) - norm
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        sums, down = _rank_hashes(points)
        h = mixed((sums[ends] - sums[ends - lengths]) * down[ends - lengths])
        order = np.argsort(h)
        self.hashes, self.ids, self.weights = h[order], np.array(usual, np.int32)[order], weight[order]
        top = (self.hashes >> np.uint64(64 - _TOP_BITS)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << _TOP_BITS) + 1)).astype(np.int32)
        #: By a hash's top bits: 1 if it may be a piece, 2 if it may be the beginning of a longer one.
        self.flags = (self.first[1:] > self.first[:-1]).astype(np.uint8)
        for length in range(1, int(lengths.max())):
            begin = (ends - lengths)[lengths > length]
            more = mixed((sums[begin + length] - sums[begin]) * down[begin])
            self.flags[(more >> np.uint64(64 - _TOP_BITS)).astype(np.int64)] |= 2
        self.longest = int(lengths.max())
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes_of = np.full(size, None, object)
        for i, p in zip(usual, pieces):
            self.bytes_of[i] = p.replace(MARK, " ").encode("utf-8", "surrogatepass")
        for value, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([value])
        self.byte_weight = float(-np.log(size + 3.0) - norm)

    def words(self, text: str) -> list[str]:
        """The units without their first mark."""
        if text and not self.crossing and text[0] != " " != text[-1] and "  " not in text and MARK not in text:
            return text.split(" ")
        return [unit[1:] for unit in self.units(text)]

    def units(self, text: str) -> list[str]:
        """The text with marks for spaces and one before it, cut where no piece can cross."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        return [marked] if self.crossing and marked else _UNIT.findall(marked)

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation's ids in UTF-8, as the model decodes it: pieces in a row, without the first space."""
        return b"".join(self.bytes_of[ids].tolist()).removeprefix(b" ")

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, where those are, and which may go on to a longer piece."""
        top = (h >> np.uint64(64 - _TOP_BITS)).astype(np.int64)
        flags = self.flags[top]
        open_ = np.flatnonzero(flags & 1)
        at, end, found, spots = self.first[top[open_]], self.first[top[open_] + 1], [], []
        while len(open_):
            hit = self.hashes[at] == h[open_]
            found.append(open_[hit])
            spots.append(at[hit])
            more = ~hit & (at + 1 < end)
            open_, at, end = open_[more], at[more] + 1, end[more]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found]), np.concatenate([none, *spots]), np.flatnonzero(flags & 2)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """The lattices of many units at once. A node is a place in a unit; edges are sorted by node."""

    def __init__(self, units: list[str], v: Vocabulary):
        self.v = v
        lengths = np.array([len(u) for u in units], np.int64)
        self.root = np.concatenate([[0], np.cumsum(lengths)])
        degree, parts = [], [[np.zeros(0, kind)] for kind in (np.int32, np.int32, np.int32, float, float)]
        begin = 0
        while begin < len(units):  # in parts whose arrays stay in a processor's cache
            end = max(int(np.searchsorted(self.root, self.root[begin] + BLOCK, "right")) - 1, begin + 1)
            own, *found = self._edges("".join(units[begin:end]), lengths[begin:end])
            degree.append(own)
            for k, (column, x) in enumerate(zip(parts, found)):
                column.append((x + self.root[begin]).astype(np.int32) if k < 2 else x)
            begin = end
        self.source, self.target, self.piece, self.log_p, self.keys = (np.concatenate(parts.pop(0)) for _ in range(5))
        self.head = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *degree]))])
        self.keys += self.source
        self._chains(len(units))
        # ids: the only one of an edge, or -1 - a place among the code points of several bytes
        self.only = self.piece.copy()
        odd = np.flatnonzero(self.piece < 0)
        codes, where = np.unique(-1 - self.piece[odd], return_inverse=True)
        self.several = [v.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in codes.tolist()]
        self.only[odd] = np.array([ids[0] if len(ids) == 1 else -1 - k for k, ids in enumerate(self.several)], np.int32)[where]

    def _edges(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges of the units that ``text`` joins: how many each place has, then their sources, targets, pieces, log-probabilities and sums of probabilities."""
        v = self.v
        root = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        sums, down = _rank_hashes(points)
        stop = np.repeat(root[1:], lengths)  # a unit's end
        at_all = np.arange(n)
        covered, degree = np.zeros(n, bool), np.zeros(n, np.int64)
        source, rank, piece, weight, target = [], [], [], [], []

        def add(at: np.ndarray, found: np.ndarray, weights: np.ndarray, length: int) -> None:
            source.append(at)
            rank.append(degree[at])
            piece.append(found)
            weight.append(weights)
            target.append(at + length)
            degree[at] += 1

        at = at_all
        for length in range(1, v.longest + 1):
            at = at[at + length <= stop[at]]
            if not len(at):
                break
            h = mixed((sums[at + length] - sums[at]) * down[at])
            hit, spot, longer = v.find(h)
            add(at[hit], v.ids[spot], v.weights[spot], length)
            if length == 1:
                covered[at[hit]] = True
                bare = np.flatnonzero(~covered)  # a code point without a piece: its bytes; -1 - code point stands for them
                n_bytes = 1 + (points[bare] > 0x7F).astype(np.int64) + (points[bare] > 0x7FF) + (points[bare] > 0xFFFF)
                add(bare, -1 - points[bare].astype(np.int32), v.byte_weight * n_bytes, 1)
            at = at[longer]
        # edges by source, then target
        head = np.concatenate([[0], np.cumsum(degree)])
        place = head[np.concatenate(source)] + np.concatenate(rank)
        sources, targets, pieces, edge_weight = (np.empty(len(place), kind) for kind in (np.int64, np.int64, np.int32, float))
        for column, parts in ((sources, source), (targets, target), (pieces, piece), (edge_weight, weight)):
            column[place] = np.concatenate(parts)
        # backward sums, by distance from the unit's end
        away = stop - at_all
        by_away = np.argsort(away.astype(np.uint16) if lengths.max() < 1 << 16 else away, kind="stable")
        own = degree[by_away]
        first = np.concatenate([[0], np.cumsum(own)])
        edges = np.repeat(head[by_away] - first[:-1], own) + np.arange(len(place))
        w, last = edge_weight[edges], np.repeat(stop[by_away], own)
        t = targets[edges]
        inner, t = t < last, np.minimum(t, n - 1)
        level = np.searchsorted(away[by_away], np.arange(1, int(lengths.max()) + 2))
        beta = np.zeros(n)
        for a, b in zip(level[:-1].tolist(), level[1:].tolist()):
            if b > a:
                lo, hi = first[a], first[b]
                x = w[lo:hi] + np.where(inner[lo:hi], beta[t[lo:hi]], 0.0)
                beta[by_away[a:b]] = np.logaddexp.reduceat(x, first[a:b] - lo)
        log_p = edge_weight - beta[sources]
        log_p[edges] += np.where(inner, beta[t], 0.0)
        total = np.cumsum(np.exp(log_p))
        cum = total - np.concatenate([[0.0], total])[head[sources]]
        cum[head[1:] - 1] = 1.0
        return degree, sources, targets, pieces, log_p, np.minimum(cum, 1.0)

    def _chains(self, n_units: int) -> None:
        """Each place's likeliest edge, and for each unit the chain of those: its edges, their number, log-probability and probability."""
        self.best = np.zeros(len(self.head) - 1, np.int32)
        if len(self.best):
            top = np.flatnonzero(self.log_p == np.repeat(np.maximum.reduceat(self.log_p, self.head[:-1]), np.diff(self.head)))
            self.best[self.source[top][::-1]] = top[::-1]  # the first of equals
        self.chain_log_p, self.chain_p, self.chain_size, steps = np.zeros(n_units), np.ones(n_units), np.zeros(n_units, np.int32), []
        live, node = np.arange(n_units), self.root[:-1]
        while len(live):
            edge = self.best[node]
            self.chain_log_p[live] += self.log_p[edge]
            self.chain_p[live] *= np.exp(self.log_p[edge])
            self.chain_size[live] += 1
            steps.append((live, edge))
            node = self.target[edge]
            more = node < self.root[live + 1]
            live, node = live[more], node[more]
        ends = np.cumsum(self.chain_size, dtype=np.int64)
        self.chain_at = ends - self.chain_size
        self.chain_edges = np.zeros(int(self.chain_size.sum()), np.int32)
        for step, (live, edge) in enumerate(steps):
            self.chain_edges[self.chain_at[live] + step] = edge
        self.chain_log_p = np.minimum(self.chain_log_p, 0.0)

    def sample(self, units: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each unit: its log-probability, its number of edges, and all edges in order.

        A unit's first number says how far it follows its chain: all the way, below the chain's probability. Units
        that leave it take another edge there and walk on, with a number a step.
        """
        u = _unit_interval(salts)
        log_p, counts = self.chain_log_p[units], self.chain_size[units]
        off = np.flatnonzero(u >= self.chain_p[units])
        off = off[np.argsort(units[off], kind="stable")]  # near units' walks share the cache
        walks = [self._walk(units[some], salts[some], u[some]) for some in np.split(off, range(BLOCK, len(off), BLOCK)) if len(some)]
        if walks:
            log_p[off], counts[off] = np.concatenate([w[0] for w in walks]), np.concatenate([w[1] for w in walks])
        edge_at = np.cumsum(counts, dtype=np.int64) - counts
        edges = np.repeat(self.chain_at[units] - edge_at, counts)
        edges += np.arange(len(edges))
        edges = self.chain_edges.take(edges, mode="clip")
        for walk, begin in zip(walks, range(0, len(off), BLOCK)):
            begins = edge_at[off[begin : begin + BLOCK]]
            for step, (some, edge) in enumerate(walk[2]):
                edges[begins[some] + step] = edge
        return log_p, counts, edges

    def _walk(self, units: np.ndarray, salts: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For ascending units that leave their chain as soon as its probability so far is at most ``leave``: log-probabilities, numbers of edges and steps."""
        lo, hi = self.head[self.root[units[0]]], self.head[self.root[units[-1] + 1]]
        keys, source, target, weight = self.keys[lo:hi], self.source[lo:hi], self.target[lo:hi], self.log_p[lo:hi]
        log_p, counts, steps = np.zeros(len(units)), np.zeros(len(units), np.int32), []
        live, node, end, salt = np.arange(len(units)), self.root[units], self.root[units + 1], salts
        followed, on = np.ones(len(units)), np.ones(len(units), bool)
        while len(live):
            salt = salt + _M
            u = _unit_interval(salt)
            best = self.best[node] - lo
            p = np.exp(weight[best])
            stays = on & (leave < followed * p)
            leaves = on & ~stays
            u = np.where(leaves, u * (1.0 - p), u)
            u += np.where(leaves & (u >= keys[best] - node - p), p, 0.0)  # past the chain's edge
            edge = np.minimum(np.searchsorted(keys, node + u), hi - lo - 1)
            wrong = np.flatnonzero(source[edge] != node)  # u was rounded away: the last edge of the node before; or up: the first of the next
            edge[wrong] = np.where(u[wrong] < 0.5, self.head[node[wrong]], self.head[node[wrong] + 1] - 1) - lo
            edge = np.where(stays, best, edge)
            log_p[live] += weight[edge]
            counts[live] += 1
            steps.append((live, (edge + lo).astype(np.int32)))
            node = target[edge]
            more = np.flatnonzero(node < end)
            followed = (followed * p)[more]
            live, node, end, salt, on, leave = live[more], node[more], end[more], salt[more], stays[more], leave[more]
        return np.minimum(log_p, 0.0), counts, steps

    def sample_others(self, units: np.ndarray, salts: np.ndarray, barred: list[list[np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        """For each unit a segmentation that is none of its ``barred`` (as edges), with its log-probability among all."""
        job = np.repeat(np.arange(len(units)), [len(b) for b in barred])
        flat = [b for own in barred for b in own]
        sizes = np.array([len(b) for b in flat], np.int64)
        at = np.cumsum(sizes) - sizes
        bars = np.concatenate(flat).astype(np.int64)
        mass = np.exp(np.concatenate([np.cumsum(self.log_p[b][::-1])[::-1] for b in flat]))  # of all that goes on as a barred one from here
        live, node, end, found = np.arange(len(units)), self.root[units], self.root[units + 1], [[] for _ in units]
        bar = np.arange(len(flat))  # barred ones that began as their job's edges so far
        row = np.zeros(len(units), np.int64)
        for step in count():
            lo, hi = self.head[node], self.head[node + 1]
            edges = lo[:, None] + np.arange(int((hi - lo).max()))
            free = np.where(edges < hi[:, None], np.exp(self.log_p[np.minimum(edges, len(self.log_p) - 1)]), 0.0)
            row[live] = np.arange(len(live))
            who, own = row[job[bar]], at[bar] + step
            np.subtract.at(free, (who, bars[own] - lo[who]), mass[own])
            free = np.cumsum(np.maximum(free, 0.0), axis=1)
            u = (mixed(salts[live] + np.uint64(step)).astype(np.float64) + 1) / (2.0**64 + 2)
            edge = lo + np.minimum((free < (u * free[:, -1])[:, None]).sum(axis=1), hi - lo - 1)
            for j, e in zip(live.tolist(), edge.tolist()):
                found[j].append(e)
            bar = bar[bars[own] == edge[who]]
            node = self.target[edge]
            more = node < end
            if not more.any():
                break
            stays = np.zeros(len(units), bool)
            stays[live[more]] = True
            bar = bar[stays[job[bar]]]
            live, node, end = live[more], node[more], end[more]
        return [(min(float(self.log_p[edges].sum()), 0.0), np.array(edges, np.int32)) for edges in found]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edges; an edge of a code point without a piece gives its bytes."""
        found = self.only[edges]
        if len(found) and found.min() < 0:
            parts, last = [], 0
            for k in np.flatnonzero(found < 0).tolist():
                parts += [found[last:k], self.several[-1 - int(found[k])]]
                last = k + 1
            found = np.concatenate([*parts, found[last:]])
        return found


def _below(z: np.ndarray, bound: float | np.ndarray) -> np.ndarray:
    """Gumbels z conditioned to lie below ``bound``."""
    return -np.logaddexp(-bound, -z)


def _unit_interval(salts: np.ndarray) -> np.ndarray:
    return (mixed(salts) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _uniform(salts: np.ndarray) -> np.ndarray:
    """What the Gumbels of sets are made of."""
    return _unit_interval(salts ^ np.uint64(0xC2B2AE3D27D4EB4F))


class _Path:
    """An emitted segmentation: log-probability and number of edges of each unit's choice, and all edges."""

    __slots__ = ("log_p", "counts", "edges", "value")

    def __init__(self, log_p: np.ndarray, counts: np.ndarray, edges: np.ndarray, value: float):
        self.log_p, self.counts, self.edges, self.value = log_p, counts, edges, value

    def choice(self, i: int) -> np.ndarray:
        at = int(self.counts[:i].sum())
        return self.edges[at : at + int(self.counts[i])]


class _Search:
    """The search over one row's units."""

    def __init__(self) -> None:
        self.heap: list[tuple] = []
        self.paths: list[_Path] = []


def _sets(log_p: np.ndarray, prefix: np.ndarray, spent: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Free Gumbels of the sets that fall apart at each unit, -inf where there is none; a row of ``log_p`` begins at the first free unit."""
    rest = 1.0 - np.exp(log_p)
    rest[:, 0] -= spent
    open_ = rest > CERTAIN
    mass = prefix[:, None] + np.cumsum(log_p, axis=1) - log_p + np.log(np.where(open_, rest, 1.0))
    return np.where(open_, mass - np.log(-np.log(np.clip(u, 2.0**-53, 1 - 2.0**-53))), -np.inf)


def _push_all(jobs: list[tuple], row_at: np.ndarray, row_of: np.ndarray, log_p: np.ndarray, salts: np.ndarray, k: int) -> None:
    """The rest of each job's node, whose member its path is: (row, search, path, first free unit, paths barred there, their mass, prefix).

    The first sets of all rows are valued at once. A later set can only be among a row's best if its Gumbel is as
    large as its prefix asks for; rows with such a set are valued whole.
    """
    rows = np.array([job[0] for job in jobs])
    begin = row_at[rows] + np.array([job[3] for job in jobs])
    left = row_at[rows + 1] - begin
    spent, prefix = np.array([job[5] for job in jobs]), np.array([job[6] for job in jobs])
    at = begin[:, None] + np.arange(FIRST_SETS)
    inside = at < row_at[rows + 1][:, None]
    at = np.where(inside, at, 0)
    if len(log_p):
        z = _sets(np.where(inside, log_p[at], 0.0), prefix, np.where(left > 0, spent, 0.0), _uniform(salts[at]))
    else:
        z = np.full(at.shape, -np.inf)
    best = np.argsort(-z, axis=1, kind="stable")
    ranked = np.take_along_axis(z, best, axis=1)
    most = np.array([max(k + 1 - len(job[1].paths), 1) for job in jobs])
    least = np.where(most > FIRST_SETS, -np.inf, ranked[np.arange(len(jobs)), np.minimum(most, FIRST_SETS) - 1])
    total = np.cumsum(log_p)
    before = total - log_p
    asked, later = np.full(len(row_at) - 1, -np.inf), np.full(len(row_at) - 1, np.iinfo(np.int64).max)
    some = np.flatnonzero(left > FIRST_SETS)
    asked[rows[some]] = prefix[some] - before[begin[some]] - least[some] + 1e-6
    later[rows[some]] = begin[some] + FIRST_SETS
    before += np.repeat(asked, np.diff(row_at))
    hit = np.flatnonzero(before > _LEAST_LOG)
    hit = hit[hit >= later[row_of[hit]]]
    hit = hit[1.0 - _uniform(salts[hit]) < np.exp(np.minimum(before[hit], 0.0))]
    whole = set(row_of[hit].tolist())
    for r, (row, search, path, first, taken, spent_r, prefix_r) in enumerate(jobs):
        own, at = ranked[r], best[r]
        if row in whole:
            one = slice(begin[r], begin[r] + left[r])
            every = _sets(log_p[None, one], prefix[r : r + 1], spent[r : r + 1], _uniform(salts[None, one]))[0]
            at = np.argsort(-every, kind="stable")
            own = every[at]
        own, at = own[: most[r]], at[: most[r]]
        for i, x in zip(at.tolist(), _below(own, path.value).tolist()):
            if x == -np.inf:
                break
            barred = (*(taken if i == 0 else ()), path)
            mass = (spent_r if i == 0 else 0.0) + float(np.exp(path.log_p[first + i]))
            heapq.heappush(search.heap, (-x, len(search.paths), first + i, len(search.heap), barred, mass))


def segmentations(rows: list[tuple[int, str]], v: Vocabulary, k: int, seed: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """For each (key, text): up to k of (ids, log-probability, perturbed log-probability, inclusion score)."""
    index: dict[str, int] = defaultdict(count().__next__)
    own = [np.fromiter(map(index.__getitem__, words), np.int32, len(words)) for words in (v.words(text) for _, text in rows)]
    lattices = Lattices([MARK + word for word in index], v)
    del index
    seeds = mixed(np.array([(key * 0x9E3779B97F4A7C15 + seed) % 2**64 for key, _ in rows], np.uint64))
    begin, size = 0, 0
    for end, units in enumerate(own, 1):
        size += len(units)
        if size >= SEARCHED or end == len(own):
            yield from _searched(own[begin:end], seeds[begin:end], lattices, k)
            begin, size = end, 0


def _searched(rows: list[np.ndarray], seeds: np.ndarray, lattices: Lattices, k: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """The searches over rows of units, round by round for all at once."""
    lengths = np.array([len(units) for units in rows], np.int64)
    units = np.concatenate(rows)
    row_at = np.concatenate([[0], np.cumsum(lengths)])
    row_of = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    place = (np.arange(len(units)) - np.repeat(row_at[:-1], lengths)).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    searches = [_Search() for _ in rows]
    first_values = -np.log(-np.log((mixed(seeds).astype(np.float64) + 1) / (2.0**64 + 2)))
    for round_ in range(k):
        bases = mixed(seeds + np.uint64(round_ * 0x632BE59BD9B4E019 % 2**64))
        nodes = [heapq.heappop(s.heap) if s.heap else None for s in searches] if round_ else []
        if round_ and not any(nodes):
            break
        salts = mixed(place + np.repeat(bases, lengths))
        log_p, counts, sampled_edges = lattices.sample(units, salts)
        sampled_at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        jobs, others = [], {}
        if round_:
            live = [r for r, node in enumerate(nodes) if node]
            at = row_at[live] + [nodes[r][2] for r in live]
            found = lattices.sample_others(units[at], salts[at], [[path.choice(nodes[r][2]) for path in nodes[r][4]] for r in live])
            others = dict(zip(live, found))
            for r, (other_p, other) in others.items():
                begin, i, parent = row_at[r], nodes[r][2], nodes[r][4][-1]
                log_p[begin : begin + i], log_p[begin + i] = parent.log_p[:i], other_p
                counts[begin : begin + i], counts[begin + i] = parent.counts[:i], len(other)
        for r, s in enumerate(searches):
            if round_ and r not in others:
                continue
            begin, end = row_at[r], row_at[r + 1]
            edges, value = sampled_edges[sampled_at[begin] : sampled_at[end]], float(first_values[r])
            if round_:
                value, _, i, _, barred, spent = nodes[r]
                kept = barred[-1].edges[: int(barred[-1].counts[:i].sum())]
                edges, value = np.concatenate([kept, others[r][1], sampled_edges[sampled_at[begin + i + 1] : sampled_at[end]]]), -value
            path = _Path(log_p[begin:end], counts[begin:end], edges, value)
            if round_:
                jobs.append((r, s, path, i, barred, spent, float(path.log_p[:i].sum())))
            else:
                jobs.append((r, s, path, 0, (), 0.0, 0.0))
        _push_all(jobs, row_at, row_of, log_p, salts, k)
        for _, s, path, *_ in jobs:
            s.paths.append(path)
    for s in searches:
        threshold = -s.heap[0][0] if s.heap else -np.inf
        out = []
        for path in s.paths:
            total = float(path.log_p.sum())
            score = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(total - threshold, 50.0))))
            out.append((lattices.ids(path.edges), total, path.value, score))
        s.paths, s.heap = [], []
        yield out


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def decode(ids: list[int], path: str) -> str:
    """The text of ids, by the model itself."""
    return _model(path).decode(ids)


def decoded(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with the text of their ids as ``text_col``, by the model itself.

    Null ids give null, no ids an empty text, a null inside ids is left out; an id outside the vocabulary fails the
    job. A column ``text_col`` of ``rows`` is replaced; an empty table gives no rows.
    """
    rest = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != text_col])
    schema = T.StructType([*rest.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_file)
        for whole in batches:
            for at in range(0, len(whole), OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                found = [None if not ids.is_valid else model.decode([i for i in ids.as_py() if i is not None]) for ids in batch.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text_col])

    return rest.mapInArrow(run, schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if kind != pa.list_(pa.int32()):
        return pa.array(values, kind)
    bounds = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def sampled(docs: DataFrame, model_file: str, k: int = 4, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text_crc32: bool = False) -> DataFrame:
    """Up to k rows per input row: id, sample (from 0), n_pieces, ids_crc32, log_prob, perturbed, inclusion and, if asked for, ids
    and text_crc32, the CRC of the text that the model decodes the ids to.

    The samples of a row are distinct and ordered by ``perturbed``; a row with fewer segmentations gives them
    all with an inclusion of 1 each. Null and empty texts give one sample without pieces. Rows that repeat a key
    and text give the same samples; a null key counts as 0 for the seed; an empty table gives no rows; other
    columns are ignored.
    """
    names = ["id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", *["ids"] * with_ids, *["text_crc32"] * with_text_crc32]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *[pa.list_(pa.int32())] * with_ids, *[pa.int64()] * with_text_crc32]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)

        def emit(held: list[tuple[int | None, str]]) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in names]
            for (key, _), found in zip(held, segmentations([(key or 0, text) for key, text in held], v, k, seed)):
                for sample, (ids, log_p, value, score) in enumerate(found):
                    more = [ids] * with_ids
                    if with_text_crc32:
                        more.append(zlib.crc32(v.decoded(ids)))
                    for column, x in zip(out, (key, sample, len(ids), zlib.crc32(ids.astype("<i4", copy=False)), log_p, value, score, *more)):
                        column.append(x)
                if len(out[0]) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([_column(c, t) for c, t in zip(out, kinds)], names=names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([_column(c, t) for c, t in zip(out, kinds)], names=names)

        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                held.append((key, text.as_py() or ""))
                size += len(held[-1][1])
                if size > CHUNK_CHARS:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    schema = "id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double" + ", ids array<int>" * with_ids + ", text_crc32 long" * with_text_crc32
    return plain(docs, id=id_col, text=text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
