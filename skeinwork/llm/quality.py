"""Quality rules with adaptive thresholds.

Fixed cutoffs on shape metrics are replaced by fences per language and source. A metric's distribution
is a log-bucket quantile sketch: a row per (lang, source, metric, bucket) with a count. Sketches merge
by adding counts, exactly and in any order, so a lost task that runs again gives the same sketch, and a
quantile has a relative error of at most (GAMMA - 1) / 2. The quantiles of a (lang, source) lean on the
merged sketch of its language, and these on the corpus's, the less the more documents it has: no number of rows
switches from one to the other. Fences rest on lower quantiles, so they stand while less than three
quarters of a group is junk; and no fence is above those of language and corpus for metrics that don't hang on
the language, or far above the language's median source for those that do, so a source that is mostly or all
junk can't set its own, and a hot one can't set the others'. The fences are then
joined to the documents as filters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.shared import cut, plain
from skeinwork.llm.words import WHITE, chunks, lines, range_hashes, texts, windows, words

GAMMA = 1.005
#: The merged sketch weighs in a group's quantiles like so many documents of its own.
PRIOR = 200
#: metric -> least distance of the fence from the first quartile, for groups without a spread; a fence is q25 + REACH * (q25 - q10), or that distance if it is larger.
MARGINS = {"symbol_ratio": 0.25, "dup_line_ratio": 0.35, "long_word": 1.0}
REACH = 12.0
#: In metrics that hang on the language a source's fence is at most so many times its language's median fence over sources.
SLACK = 1.25
#: Metrics that mean the same in every language; word length doesn't.
COMMON = ("symbol_ratio", "dup_line_ratio")
#: Broadcast the fences only up to so many groups; beyond, the join is shuffled and skew-split.
BROADCAST_GROUPS = 20_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STATS = "id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of each text."""
    n = len(offsets) - 1
    starts, ends, rows = words(data, offsets)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": per_row(~WHITE[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_row(_SYMBOL[data])}
    # lines: a later line equal to an earlier one of the same row; blank lines don't count
    first, last, of = lines(data, offsets)
    solid = np.concatenate([[0], np.cumsum(~WHITE[data], dtype=np.int64)])
    full = solid[last] > solid[first]
    first, last, of = first[full], last[full], of[full]
    h = range_hashes(data, first, last)
    order = np.lexsort((h, of))
    again = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
    out["n_dup_lines"] = np.bincount(of[order][1:][again], minlength=n)
    # words covered by windows of five words that the row has twice or more
    found, at = windows(range_hashes(data, starts, ends), rows, 5)
    key = rows[at]
    order = np.lexsort((found, key))
    same = (found[order][1:] == found[order][:-1]) & (key[order][1:] == key[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(rows) + 6, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(cover)[: len(rows)] > 0], minlength=n)
    out["n_lines"] = np.bincount(of, minlength=n)  # without blank ones
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        for a, b in chunks(offsets):
            lo, hi = offsets[a], offsets[b]
            got = measures(data[lo:hi], offsets[a : b + 1] - lo)
            rest = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [rest.column("id").cast(pa.int64()), rest.column("lang"), rest.column("source"), *(pa.array(v.astype(np.int64)) for v in got.values())],
                names=["id", "lang", "source", *got],
            )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The base measures of every row, over its whole text."""
    rows = plain(docs, id=id_col, text=text_col, lang=lang_col, source=source_col)
    return rows.mapInArrow(_measured, STATS)


def _metrics(columns: list[str]) -> dict[str, Column]:
    """The metrics of stats with these columns; without n_lines a word counts as a line."""
    n = F.greatest("n_words", F.lit(1))
    n_lines = F.greatest("n_lines" if "n_lines" in columns else "n_words", F.lit(1))
    return {"symbol_ratio": F.col("n_symbols") / n, "dup_line_ratio": F.col("n_dup_lines") / n_lines, "long_word": F.col("word_chars") / n}


def _bucket(value: Column) -> Column:
    return F.when(value <= 0, F.lit(-(10**6))).otherwise(F.ceil(F.log(value) / math.log(GAMMA))).cast("int")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket) -> count: the mergeable form."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(v).alias("bucket")) for m, v in _metrics(stats.columns).items()])
    return stats.select("lang", "source", F.explode(entries).alias("e")).groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches to coarser groups."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """q10, q25, q50 and q75 of each group and metric, with its number of documents. A sketch has a few thousand buckets at most, whatever the input."""
    by = Window.partitionBy(*keys, "metric")
    run = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    value = F.when(F.col("bucket") <= -(10**6), F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    return run.groupBy(*keys, "metric").agg(*[at(q / 100).alias(f"q{q}") for q in (10, 25, 50, 75)], F.max("total").alias("total"))


def _fence(at: Column, spread: Column) -> Column:
    margin = F.create_map(*[F.lit(x) for pair in MARGINS.items() for x in pair])[F.col("metric")]
    return at + F.greatest(margin, REACH * spread)


def _middle(fenced: DataFrame, *keys: str) -> DataFrame:
    """The sources' median fence per coarser group, for which a hot source counts once; from a sketch, too."""
    counts = fenced.select(*keys, "metric", _bucket(F.col("fence")).alias("bucket")).groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return quantiles(counts, *keys).select(*[F.col(c).alias(f"m_{c}") for c in (*keys, "metric", "q50")])


def fences(stats: DataFrame) -> DataFrame:
    """lang, source and a column per metric: the adaptive upper threshold."""
    sketch = cut(sketches(stats), "quality-sketch")
    own, lang, whole = (quantiles(merged(sketch, *keys), *keys) for keys in (("lang", "source"), ("lang",), ()))
    named = lambda df, to, *keys: df.select(*[F.col(c).alias(f"{to}_{c}") for c in (*keys, "metric", "q10", "q25", "total")])
    both = own.join(named(lang, "l", "lang"), F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    both = both.join(F.broadcast(named(whole, "w")), F.col("metric") == F.col("w_metric"))  # one row per metric
    # quartile and spread lean on the coarser group's with the weight of PRIOR documents; a language has its own place in metrics that hang on it
    lean = lambda n, own, to: (F.col(n) * own + PRIOR * to) / (F.col(n) + PRIOR)
    spread = lambda to: F.col(f"{to}q25") - F.col(f"{to}q10")
    l_at = F.when(F.col("metric").isin(*COMMON), lean("l_total", F.col("l_q25"), F.col("w_q25"))).otherwise(F.col("l_q25"))
    l_spread = lean("l_total", spread("l_"), spread("w_"))
    fence = _fence(lean("total", F.col("q25"), l_at), lean("total", spread(""), l_spread))
    fenced = cut(both.select("lang", "source", "metric", fence.alias("fence"), _fence(l_at, l_spread).alias("l_fence"), _fence(F.col("w_q25"), spread("w_")).alias("w_fence")), "quality-group-fences")
    by_lang, by_all = _middle(fenced, "lang"), _middle(fenced).withColumnsRenamed({"m_metric": "a_metric", "m_q50": "a_q50"})
    found = fenced.join(by_lang, F.col("lang").eqNullSafe(F.col("m_lang")) & (F.col("metric") == F.col("m_metric"))).join(F.broadcast(by_all), F.col("metric") == F.col("a_metric"))
    common = F.least("l_fence", "m_q50", "w_fence", "a_q50")
    bound = F.least("fence", F.when(F.col("metric").isin(*COMMON), common).otherwise(SLACK * F.col("m_q50")))
    return found.groupBy("lang", "source").pivot("metric", list(MARGINS)).agg(F.max(bound))


def _rejections(columns: list[str], min_words: int, max_repeat_percent: int) -> tuple[Column, Column]:
    """Whether the base rules reject a row, and whether its metrics lie within its group's fences."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    within = F.lit(True)
    for metric, value in _metrics(columns).items():
        within &= F.coalesce(value <= F.col(f"f_{metric}"), F.lit(True))
    return failed, within


def _with_fences(stats: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.withColumnsRenamed({m: f"f_{m}" for m in MARGINS} | {"lang": "f_lang", "source": "f_source"})
    side = F.broadcast(limits) if limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else limits
    return stats.join(side, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """One row per input row: id, the base measures, base_failed and kept.

    ``base_failed``: under ``min_words`` words, or over ``max_repeat_percent`` of the words repeated.
    ``kept``: not base_failed and no metric above the fence of the row's (lang, source). Null text has no
    words and fails; null lang or source is a group of its own; repeated rows are judged alike; an empty
    table gives no rows; other columns are ignored.
    """
    stats = cut(measured(docs, id_col, text_col, lang_col, source_col), "quality-measures")
    found = _with_fences(stats, cut(fences(stats), "quality-fences"))
    failed, within = _rejections(found.columns, min_words, max_repeat_percent)
    return found.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns. Whole rows ride along with their measures, so no text is shuffled."""
    limits = cut(fences(cut(measured(docs, id_col, text_col, lang_col, source_col), "quality-measures")), "quality-fences")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for a, b in chunks(offsets):
                lo, hi = offsets[a], offsets[b]
                got = measures(data[lo:hi], offsets[a : b + 1] - lo)
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [some.column("lang"), some.column("source"), some.column("rest"), *(pa.array(v.astype(np.int64)) for v in got.values())], names=["lang", "source", "rest", *got]
                )

    schema = T.StructType([*rows.drop("text").schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]])
    found = _with_fences(rows.mapInArrow(run, schema), limits)
    failed, within = _rejections(found.columns, min_words, max_repeat_percent)
    return found.filter(~failed & within).select("rest.*")
