"""Exact and near dedup, repeated strings, shards and url rules on small made-up tables, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skeinwork.llm import components, exact_dedup, ngram_join, sharding, substring_dedup, url_filters
from skeinwork.llm.suffix_array import suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def base_words(n, start=0):
    return " ".join(f"w{i * 7919 % 1000}x{i}" for i in range(start, start + n))


def corpus():
    a = base_words(60)
    near = a.replace("w919x1", "changed")
    texts = [a, a + " ", near, base_words(60, 500), None, "", "one two", "One TWO", "short", a.upper(), base_words(30) + " z", near, "é" * 80, "é" * 80 + "!"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(docs, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, width=k, percent=percent).collect()}
    assert got == brute_components(corpus(), k, percent)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = base_words(40).split()
    rows = []
    for i in range(12):  # neighbours link, ends don't
        rows.append((i, " ".join(words[i : i + 40] + [f"new{j}" for j in range(i)]), "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows, 4, 85) and len({c for _, c in got.values()}) < 12


@pytest.mark.parametrize("block", [5])
def test_a_dense_group_of_near_misses_and_links(spark, monkeypatch, block):
    """Most neighbours link, others just miss; every member shares rare shingles with very many."""
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", block)
    rng = random.Random(4)
    words = base_words(70).split()
    rows = []
    for i in range(90):
        own = list(words)
        for j in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"{i}y{j}"
        rows.append((i * 3 % 91, " ".join(own), "en", "s", 0))
    want = brute_components(rows, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and 3 < len({c for _, c in want.values()}) < 80


def test_rows_without_or_with_repeated_ids_link_by_their_texts(spark):
    words = base_words(60).split()
    near = lambda *at: " ".join(f"new{i}" if i in at else w for i, w in enumerate(words))
    far = lambda k: " ".join(f"q{k}z{i}" for i in range(40))
    rows = [(7, near()), (None, near(0)), (9, near(59)), (9, far(1)), (10, far(1) + " x"), (None, far(2)), (None, far(2)), (None, far(2) + " y"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect())
    want = [(7, 57, 7), (None, 57, 7), (9, 57, 7), (9, 37, 9), (10, 38, 9), (None, 37, None), (None, 37, None), (None, 38, None), (None, 0, None), (3, 0, 3)]
    assert got == sorted((str(i), n, c) for i, n, c in want)
    kept = [(r.doc_id, r.text) for r in ngram_join.one_per_component(df.withColumn("rep", F.lit("clash")), width=4, percent=85).collect()]
    assert kept.count((7, near())) == 1 and (None, near(0)) not in kept and (9, near(59)) not in kept and (9, far(1)) in kept and (10, far(1) + " x") not in kept
    assert len({t for i, t in kept if i is None and t}) == 1 and (None, None) in kept and (3, "") in kept


@pytest.mark.parametrize("block", [512, 3])
def test_links_are_counted_inside_components(docs, spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    words = base_words(60).split()
    rows = corpus() + [(100 + i, " ".join([*words[:i], f"other{i}", *words[i + 1 :]]), "en", "s", 0) for i in range(0, 60, 4)] + [(200 + i, " ".join(words[: 40 + i]), "en", "s", 0) for i in range(20)]
    rows += [(300 + i, " ".join([*(f"pair{j}" for j in range(50)), f"last{i}"]), "en", "s", 0) for i in range(2)]  # the smallest id has one copy
    sets = {i: shingles(t, 4) for i, t, *_ in rows}
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    want = {i: (*found, sum(link(sets[i], sets[j]) for j in sets if j != i)) for i, found in brute_components(rows, 4, 85).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_links(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and max(n for *_, n in want.values()) > 5


def test_overlaps_of_blocks():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [set(rng.choice(4000, 300, replace=False).tolist()) | set(range(9000, 9000 + k % 40)) for k in range(70)]
    tokens, owners = np.array([t for s in sets for t in s]), np.repeat(np.arange(70), [len(s) for s in sets])
    for n_a in (70, 25):
        rest = sets if n_a == 70 else sets[n_a:]
        assert ngram_join.overlaps(tokens, owners, 70, n_a).tolist() == [[len(a & b) for b in rest] for a in sets[:n_a]]


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}
    for fan_in, rounds in ((16, None), (2, 3)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, fan_in=fan_in, rounds=rounds).collect()}
        assert got == want


def test_exact_dedup_of_repeated_rows_keeps_one(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "ab"), (None, None)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(rows).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {4, 1}
    kept = exact_dedup.first_copies(rows.withColumn("id", F.lit(0)).withColumn("norm", F.lit("x")))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b"), ("None", None)]


def test_repeated_strings(spark, monkeypatch):
    shared = base_words(20)
    texts = ["start " + shared + " end", base_words(9, 700) + shared + base_words(5, 900), shared[:49], shared, "x" + shared[10:70] + "é" * 60, "é" * 60, None, "start " + shared + " end", base_words(30, 800)]
    rows = [(i, t) for i, t in enumerate(texts)]
    want, seen = {}, {}
    for i, t in rows:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if seen.setdefault(raw[s : s + 50], i) < i:
                cover[s : s + 50] = b"\1" * 50
        runs = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        want[i] = (len(raw), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(raw, cover) if not c)).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (substring_dedup.PIECE, 100):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        monkeypatch.setattr("skeinwork.llm.substring_dedup.pieces.__defaults__", (2,))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.without_repeats(df).collect()}
        assert got == want


def test_suffix_array():
    import random

    rng = random.Random(5)
    for _ in range(300):
        s = [rng.randrange(rng.choice([1, 2, 4])) if rng.random() < 0.9 else 9 for _ in range(rng.randrange(30))]
        import numpy as np

        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 4), (10, 9)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8), (10, 8)}
    assert components.components(e.limit(0)).count() == 0


def test_sharding(spark, docs):
    placed, first = sharding.shard(docs, 3)
    rows = placed.collect()
    assert len(rows) == len(corpus())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    assert {r.doc_id: r["size"] for r in rows}[4] == 1 and {r.doc_id: r.text_crc32 for r in rows}[4] == 0
    sizes = [i % 17 + 1 for i in range(sharding.SLOTS)]
    m = sharding.balanced(sizes, 16)
    load = [sum(s for s, at in zip(sizes, m.shard_of) if at == k) for k in range(16)]
    assert max(load) - min(load) <= max(sizes)
    grown = sharding.rebalanced(m, sizes, 17)
    moved = [k for k, (a, b) in enumerate(zip(m.shard_of, grown.shard_of)) if a != b]
    assert grown.version == 2 and moved and {grown.shard_of[k] for k in moved} == {16}
    load = [sum(s for s, at in zip(sizes, grown.shard_of) if at == k) for k in range(17)]
    assert max(load) < 1.05 * sum(sizes) / 17
    shrunk = sharding.rebalanced(grown, sizes, 15)
    assert max(shrunk.shard_of) == 14


def test_url_rules(spark):
    urls = [None, "no scheme", "http://A.Example.com/en/7x?q", "http://example.com/en/1", "https://x.net/de/", "https://example.net/de/80#x", "ftp://q.org", "http://notcom/en/", "http://a.com:80/en/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filters.judged_urls(df).collect()}
    assert got == {
        0: ("", "", None), 1: ("", "", None), 2: ("a.example.com", "/en/7x", "example.com/en/7"), 3: ("example.com", "/en/1", "com/en/"), 4: ("x.net", "/de/", "net/de/"),
        5: ("example.net", "/de/80", "example.net/de/8"), 6: ("q.org", "", None), 7: ("notcom", "/en/", None), 8: ("a.com:80", "/en/x", None),
    }


def test_url_templates_learn_from_labels(spark):
    urls = [(i, f"http://h.com/en/{i}") for i in range(20)] + [(20 + i, f"http://h.com/fr/{i}") for i in range(5)] + [(30 + i, f"http://k.net/de/{i}") for i in range(20)] + [(60, "http://k.net/fr/1")]
    got = {r.page_id: r.verdict for r in url_filters.judged_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert {got[i] for i in range(25)} == {"block"} and {got[i] for i in range(30, 61) if i in got} == {"allow"}


EMPTY = "doc_id long, text string, lang string, source string, n_chars long, page_id long, url string"


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
    assert substring_dedup.without_repeats(none).count() == 0
    assert sharding.shard(none)[0].count() == 0
    assert url_filters.judged_urls(none).count() == 0


def test_the_array_decides_which_strings_are_equal(monkeypatch):
    """Without a hash that tells strings apart the result stands; without the array's order it doesn't."""
    import numpy as np

    rng = random.Random(8)
    core = bytes(rng.randrange(97, 123) for _ in range(70))
    pieces = [core[a:b] + bytes(rng.randrange(97, 123) for _ in range(6)) for a, b in ((0, 60), (5, 70), (10, 66), (0, 55), (3, 70))]
    sizes, own = np.array([len(p) for p in pieces]), np.array([4, 3, 9, 1, 7])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    want = np.full(len(data), -1)
    for p, at in zip(pieces, starts.tolist()):
        for s in range(len(p) - 49):
            want[at + s] = min(o for q, o in zip(pieces, own.tolist()) if p[s : s + 50] in q)
    block = np.zeros(len(pieces), np.int64)
    monkeypatch.setattr(substring_dedup, "range_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert substring_dedup.run_minima(data, sizes, block, own, 50).tolist() == want.tolist()
    monkeypatch.setattr(substring_dedup, "suffix_arrays", lambda symbols, offsets: np.arange(len(symbols)))
    assert substring_dedup.run_minima(data, sizes, block, own, 50).tolist() != want.tolist()
