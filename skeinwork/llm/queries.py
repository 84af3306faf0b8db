"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import exact_dedup, ngram_join, packing, pii, quality, sampled_pieces, sharding, substring_dedup, token_counts, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(_table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with its ids, and the CRC of the text that they decode to."""
    return sampled_pieces.sampled(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_text_crc32=True)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged_urls(_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op2_ngram_jaccard_links": op2_ngram_jaccard_links,
        "op3_sharding": op3_sharding,
        "op4_quality_rules": op4_quality_rules,
        "op5_sampled_pieces": op5_sampled_pieces,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_url_filters": op8_url_filters,
        "op9_token_counts": op9_token_counts,
        "op10_exact_dedup": op10_exact_dedup,
    }


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER (PARTITION BY norm, doc_id ORDER BY length(t) DESC) AS nth
  FROM d
)
SELECT doc_id, keep_id, group_size, (keep_id IS NOT DISTINCT FROM doc_id AND nth = 1) AS kept, sha256(norm) AS text_sha256 FROM g
"""


def _op8_sql() -> str:
    u = url_filters
    order = sorted(u.RULES, key=lambda r: (-len(r[1]), r[1]))
    cases = []
    for verdict, rule in order:
        name, slash, start = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}') THEN '{verdict}:{rule}'")
    keys = [f"s{i + 1}" for i in range(u.DEPTH)]
    parts = [f"coalesce(g[{i + 1}], '') AS s{i + 1}" for i in range(u.DEPTH - 1)] + [f"coalesce(array_to_string(g[{u.DEPTH}:], '/'), '') AS s{u.DEPTH}"]
    kept = ", ".join(["host", *keys])
    out = f"""
WITH a AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{u.SPLIT}', 1), ''), '{u.UPPER}', '{u.LOWER}') AS host, coalesce(regexp_extract(url, '{u.SPLIT}', 2), '') AS path FROM pages
), b AS (SELECT *, CASE {' '.join(cases)} END AS hit FROM a
), c AS (
  SELECT *, CASE WHEN hit LIKE 'block:%' THEN 1 WHEN hit IS NOT NULL THEN 0 END AS label,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > {u.LONG_SEGMENT} THEN '*' ELSE s END) AS g FROM b
), found AS (SELECT page_id, host, path, hit, label, {', '.join(parts)} FROM c
), tree0 AS (SELECT {kept}, count(label) AS lab, coalesce(sum(label), 0) AS bad, '' AS template FROM found GROUP BY {kept})
"""
    share = lambda bad, lab: f"(({bad}) + {u.STRENGTH * u.PRIOR}::DOUBLE) / (({lab}) + {u.STRENGTH}::DOUBLE)"
    for i, key in enumerate(keys):
        pooled = share("p_bad", "p_lab")
        out += f""", br{i} AS (SELECT host, template, {key}, sum(lab)::DOUBLE AS b_lab, sum(bad)::DOUBLE AS b_bad FROM tree{i} GROUP BY ALL
), pa{i} AS (SELECT host, template, sum(b_lab)::DOUBLE AS p_lab, sum(b_bad)::DOUBLE AS p_bad FROM br{i} GROUP BY ALL
), st{i} AS (SELECT host, template, {key}, CASE WHEN {key} = '' THEN '' WHEN abs({share('b_bad', 'b_lab')} - {share('p_bad - b_bad', 'p_lab - b_lab')})
    > {u.Z}::DOUBLE * sqrt({pooled} * (1 - {pooled}) * (1 / (b_lab + {u.STRENGTH}::DOUBLE) + 1 / (p_lab - b_lab + {u.STRENGTH}::DOUBLE))) THEN {key} ELSE '*' END AS step
  FROM br{i} JOIN pa{i} USING (host, template)
), tree{i + 1} AS (SELECT {kept}, lab, bad, template || '/' || step AS template FROM tree{i} JOIN st{i} USING (host, template, {key}))
"""
    n = len(keys)
    out += f""", leaf AS (SELECT host, template, sum(lab)::DOUBLE AS t_lab, sum(bad)::DOUBLE AS t_bad FROM tree{n} GROUP BY ALL
), hosts AS (SELECT host, sum(lab)::DOUBLE AS h_lab, sum(bad)::DOUBLE AS h_bad FROM tree{n} GROUP BY ALL
), scored AS (SELECT host, template, (t_bad + {u.STRENGTH}::DOUBLE * ({share('h_bad', 'h_lab')})) / (t_lab + {u.STRENGTH}::DOUBLE) AS blocked_share FROM leaf JOIN hosts USING (host)
), tree AS (SELECT {kept}, template, blocked_share FROM tree{n} JOIN scored USING (host, template))
SELECT page_id, host, path, split_part(hit, ':', 2) AS rule,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, ':', 1) WHEN blocked_share >= {u.THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict,
  template, round(blocked_share, 6) AS blocked_share
FROM found JOIN tree USING ({kept})
"""
    return out


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS sh FROM w
), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p
), r(src, dst) AS (SELECT x, y FROM e UNION SELECT r.src, e.y FROM r JOIN e ON r.dst = e.x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT src, min(dst) AS m FROM r GROUP BY src) c ON c.src = s.doc_id
"""


def _op2_links_sql() -> str:
    """OP2_SQL with the number of links of each document."""
    links = "LEFT JOIN (SELECT x, count(*) AS n_links FROM e GROUP BY x) k ON k.x = s.doc_id "
    return OP2_SQL.replace("AS component_id\nFROM s ", "AS component_id, coalesce(k.n_links, 0)::BIGINT AS n_links\nFROM s " + links)


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op2_ngram_jaccard_links": _op2_links_sql(), "op8_url_filters": _op8_sql(), "op10_exact_dedup": OP10_SQL}
