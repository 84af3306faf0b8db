"""Token counts per field and section by offset-mapped attribution.

A document's fields are put together and encoded once, whole. A byte-level vocabulary gives each token's
span by its length; spans are turned to code points and interval-joined (a sorted search) to the
sections' bounds. A token that crosses a bound goes by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "majority")
#: Encode at most so many characters at once; a longer stretch is cut before a space that follows a letter, where the pattern always ends a part.
STRETCH = 1_000_000


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """``text`` in parts that encode as the whole does."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut > at + 1 and not (text[cut] == " " and text[cut - 1].isalpha() and cut + 1 < len(text) and text[cut + 1].isalpha()):
            cut -= 1
        if cut <= at + 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_bounds(text: str, path: str, pattern: str) -> np.ndarray:
    """UTF-8 offsets of the tokens' bounds, from 0 to the text's length; just 0 for an empty text."""
    encoding, lengths = _encoding(path, pattern)
    ids = [i for part in stretches(text) for i in encoding.encode_ordinary(part)]
    return np.concatenate([[0], np.cumsum(lengths[np.array(ids, np.int64)])])


def attributed(bounds: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens crossed a bound. ``sections``: bounds of the sections, from 0 to the end; empty sections get none.

    start: the section of a token's first byte; end: of its last byte; majority: the one with most of its
    bytes, the first of equals.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(RULES)}")
    starts, ends = bounds[:-1], bounds[1:]
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    own = {"start": first, "end": last, "majority": first}[rule]
    if rule == "majority":
        own = first.copy()
        for k in np.flatnonzero(last > first):
            inside = range(first[k], last[k] + 1)
            own[k] = max(inside, key=lambda s: (min(ends[k], sections[s + 1]) - max(starts[k], sections[s]), -s))
    return np.bincount(own, minlength=len(sections) - 1), int((last > first).sum())


def section_bounds(fields: Sequence[str | None], separator: str = "\n") -> tuple[str, np.ndarray, np.ndarray]:
    """The whole text of a row, the UTF-8 bounds of its sections and the field of each. A section is a line with its end; fields follow each other."""
    whole, bounds, owner, size = [], [0], [], 0
    for k, value in enumerate(fields):
        parts = (value or "").split(separator)
        for i, part in enumerate(parts):
            piece = part + separator * (i + 1 < len(parts))
            whole.append(piece)
            size += len(piece.encode())
            bounds.append(size)
            owner.append(k)
    return "".join(whole), np.array(bounds), np.array(owner, np.int64)


def token_counts(docs: DataFrame, tokenizer_file: str, pattern: str, fields: Sequence[str] = ("text",), id_col: str = "doc_id", rule: str = "start") -> DataFrame:
    """One row per input row: id, n_tokens, n_crossing, field_tokens (one per field), section_tokens (one per line, over all fields).

    Both arrays sum up to n_tokens. ``n_crossing``: tokens that crossed a bound of sections and were allocated by ``rule``.
    A null or empty field has one empty section; repeated rows are counted alike; an empty table gives no rows;
    other columns are ignored.
    """
    columns = [f"f{k}" for k in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for values in zip(*(batch.column(c) for c in columns)):
                text, sections, owner = section_bounds([v.as_py() for v in values])
                bounds = token_bounds(text, tokenizer_file, pattern)
                per_section, crossing = attributed(bounds, sections, rule)
                out[0].append(len(bounds) - 1)
                out[1].append(crossing)
                out[2].append(np.bincount(owner, weights=per_section, minlength=len(columns)).astype(np.int64))
                out[3].append(per_section.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64()))],
                names=["id", "n_tokens", "n_crossing", "field_tokens", "section_tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(f"`{f}`").alias(c) for f, c in zip(fields, columns)])
    return rows.mapInArrow(run, "id long, n_tokens long, n_crossing long, field_tokens array<long>, section_tokens array<long>").withColumnRenamed("id", id_col)
