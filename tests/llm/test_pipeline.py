"""The pipeline's stages against brute force on a small corpus."""

import random
import re

import corpus_pipeline
from skeinwork.llm import pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(i, n=60):
    rng = random.Random(i)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + f" end{i}"


def test_stages(spark, tmp_path):
    rows = [(i, text(i), "en", "s", 0) for i in range(30)]
    rows += [(100, text(3) + " ", "en", "s", 0), (101, text(5).replace("end5", "other"), "de", "s", 0), (102, "too short", "en", "s", 0), (103, None, None, None, None), (104, "a b c d e " * 20, "en", "s", 0), (105, text(77) + " mail me@x.org", "en", "s", 0)]
    rows = [(i, t, a, b, None if t is None else len(t)) for i, t, a, b, _ in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == spark.createDataFrame([], DOCS).dtypes, name
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    quality, exact, near, clean = seen
    assert set(quality) == {*range(30), 100, 101, 105}
    assert set(exact) == set(quality) - {3}  # its longer copy stays
    assert set(near) == set(exact) - {101}
    assert set(clean) == set(near) and clean[105].endswith("mail [EMAIL]") and all(clean[i] == near[i] for i in clean if i != 105)
    assert all(pii.base_spans(t) == [] for t in clean.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(clean)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and all(re.fullmatch(r"\w{1,40}", n) for n, _ in corpus_pipeline.STAGES)
