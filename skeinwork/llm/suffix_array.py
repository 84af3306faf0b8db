"""Suffix arrays of many blocks at once, by linear grouping.

First, suffixes are grouped by their first symbol, and groups are handled from the largest down. For
each member the previous suffix of a smaller group is found through the pointers of members handled
before. Suffixes that are pointed at leave their group for a new one just after it, in order of how
many members pointed at them. In the end a group holds the suffixes that share a Lyndon prefix.
Second, the array is read once from left to right: each suffix places those that end where it begins
at the front of their group. No string is renamed and nothing recurs.

The blocks don't depend on each other, so a step handles one group (then one place) of every block that
isn't done, all in array operations: the number of steps is that of the block with the most groups.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then those of the next."""
    total = np.cumsum(sizes)
    out = np.ones(int(total[-1]) if len(total) else 0, np.int64)
    out[:1] = starts[:1]
    out[total[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def _grouped(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each suffix's final group, each suffix's pointer (-1: none) and the places of all groups.

    ``text`` holds the blocks one after the other, each with a last symbol 0 that it has nowhere else.
    """
    n = len(text)
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begin = offsets[:-1][block]
    member = np.argsort(block * (int(text.max()) + 1) + text, kind="stable")  # members of a group stand together
    place = np.empty(n, np.int64)
    place[member] = np.arange(n)
    first = _edges(block[member], text[member])
    sizes = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)  # a group is named by its first place
    group[member] = np.repeat(first, sizes)
    size = np.zeros(n, np.int64)
    size[first] = sizes
    previous = np.full(n, -1)
    moved = np.zeros(n, bool)
    low, end = offsets[:-1].copy(), offsets[1:].copy()
    while len(end):
        g = group[member[end - 1]]
        s = member[_ranges(g, end - g)]
        of = np.repeat(g, end - g)
        # the previous suffix of a group that is not larger: through pointers of larger groups
        j = s - 1
        j[s == begin[s]] = -1
        late = np.flatnonzero((j >= 0) & (group[j] > of))
        while len(late):
            j[late] = previous[j[late]]
            late = late[(j[late] >= 0) & (group[j[late]] > of[late])]
        previous[s] = j
        # one of the same group: by doubling
        late = np.flatnonzero((j >= 0) & (group[j] == of))
        while len(late):
            j[late] = previous[j[late]]
            previous[s[late]] = j[late]
            late = late[(j[late] >= 0) & (group[j[late]] == of[late])]
        hit = np.sort(j[j >= 0])
        end, low = g[g > low], low[g > low]
        if not len(hit):
            continue
        at = _edges(hit)
        hit, count = hit[at], np.diff(np.append(at, len(hit)))
        home = group[hit]
        order = np.lexsort((count, home))
        hit, count, home = hit[order], count[order], home[order]
        at = _edges(home)
        many = np.diff(np.append(at, len(hit)))
        tail = home[at] + size[home[at]] - many  # pointed at members go to their group's end
        spots = _ranges(tail, many)
        moved[hit] = True
        there = member[spots]
        stay = there[~moved[there]]
        moved[hit] = False
        left = place[hit]
        left = left[left < np.repeat(tail, many)]
        member[left], place[stay] = stay, left
        member[spots], place[hit] = hit, spots
        run = _edges(home, count)
        new, length, old = spots[run], np.diff(np.append(run, len(hit))), home[run]
        own = new > old  # the lowest run keeps the group's name if nothing else is left there
        new, length, old = new[own], length[own], old[own]
        group[member[_ranges(new, length)]] = np.repeat(new, length)
        size[new] = length
        np.subtract.at(size, old, length)
    return group, previous, size


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each block symbols[offsets[b]:offsets[b + 1]] (non-negative integers), its places in ascending order of their suffixes.

    The result has the blocks' arrays one after the other, as indexes into ``symbols``; an empty block gives none.
    """
    sizes = np.diff(offsets)
    n_blocks = len(sizes)
    if not len(symbols):
        return np.zeros(0, np.int64)
    bounds = offsets - offsets[0] + np.arange(n_blocks + 1)  # each block with an end that is smaller than all
    text = np.zeros(int(bounds[-1]), np.int64)
    where = np.arange(len(symbols)) + np.repeat(np.arange(n_blocks), sizes)
    text[where] = symbols.astype(np.int64) + 1
    group, previous, size = _grouped(text, bounds)
    n = len(text)
    free = np.arange(n)  # a group's next free place
    out = np.full(n, -1)
    open_ = np.ones(n, bool)
    out[bounds[:-1]] = bounds[1:] - 1
    open_[bounds[1:] - 1] = False
    first, last = bounds[:-1], bounds[1:]
    i = first.copy()
    s = last - 2
    s[s < first] = -1
    while len(i):
        put = np.flatnonzero((s >= 0) & open_[s])
        if len(put):
            x = s[put]
            g = group[x]
            at = free[g]
            out[at] = x
            free[g] = at + 1
            open_[x] = False
            s[put] = previous[x]
        done = (s < 0) | ~open_[s]  # the chain of this place has ended: go on to the next place
        i += done
        live = i < last
        if not live.all():
            i, s, first, last, done = i[live], s[live], first[live], last[live], done[live]
        x = out[i[done]]
        s[done] = np.where(x > first[done], x - 1, -1)
    back = np.full(n, -1)
    back[where] = np.arange(len(symbols))
    ranked = back[out]
    return ranked[ranked >= 0]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``symbols`` (non-negative integers) in ascending order; an empty input gives none."""
    return suffix_arrays(symbols, np.array([0, len(symbols)]))
