"""Word, line and shingle arrays over whole texts with numpy; a batch of texts is one byte array with offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once: their arrays then stay in a processor's cache.
CHUNK = 250_000
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n + 1:
        size = max(n + 1, CHUNK + 1)
        for name, base in (("up", _M), ("down", _M_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by one prefix sum over all bytes."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BYTE[0])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to ``most`` bytes; a longer text has a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are no white space."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~WHITE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; a row has one line more than newlines."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per_row = np.ones(len(offsets) - 1, np.int64)
    np.add.at(per_row, np.searchsorted(offsets, breaks, "right") - 1, 1)
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_row)


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of every window of ``width`` words inside one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = out * _M + hashes[k : k + n]
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mixed(out[at]), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the rows' offsets into them.

    Words are lower-cased for A-Z. A row with fewer than ``width`` words has its whole sequence as one
    shingle; a row without words has none.
    """
    n_rows = len(offsets) - 1
    low = LOWER[data]
    starts, ends, rows = words(low, offsets)
    hashes = range_hashes(low, starts, ends)
    found, at = windows(hashes, rows, width)
    of = rows[at]
    counts = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        extra = np.zeros(len(short), np.uint64)
        for i, row in enumerate(short):
            h = np.uint64(counts[row])
            with np.errstate(over="ignore"):
                for w in hashes[first[row] : first[row + 1]]:
                    h = h * _M + w
            extra[i] = h
        found, of = np.concatenate([found, mixed(extra)]), np.concatenate([of, short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[fresh], of[fresh]
    return found, np.searchsorted(of, np.arange(n_rows + 1), "left")
