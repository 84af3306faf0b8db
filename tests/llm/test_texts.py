"""Quality, personal data, segmentations, packing and token counts, against brute force or exact round trips."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from skeinwork.llm import packing, pii, quality, sampled_pieces, tagger, token_counts, word_tokens
from skeinwork.llm.word_tokens import WordTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " \n\t", "a b c d e a b c d e f", "line one\nline one\n\n\nline two | x\nline one", "é à # $ a", "x " * 30, "\n".join(["same words here now ok"] * 3), "a b c\x1cd", "one two three four five six seven eight nine ten eleven"]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_measures(spark):
    rows = [(i, t, None if i % 3 else "en", "s", 0) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, *_ in rows:
        r, want = got[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (r.kept and failed)


def test_quality_fences_catch_outliers_only(spark):
    clean = [(i, " ".join(f"word{i * j % 97}x{j}" for j in range(40 + i % 9)), "en", "s", 7) for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{j}###" for j in range(40)), "en", "s", 7) for i in range(3)]
    df = spark.createDataFrame(clean + junk, DOCS).withColumn("n_words", F.lit(-1))
    got = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(3))
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(300)) and kept.first().n_words == -1
    assert quality.judged(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [30, 45, 60, 100])
def test_a_source_full_of_junk_cannot_set_its_own_fence(spark, share):
    clean = lambda i: "\n".join(" ".join(f"word{i * j % 97}x{j}" for j in range(at, at + 10)) for at in range(0, 40, 10))
    lines = lambda i: "\n".join([" ".join(f"a{i}b{j}" for j in range(60))] + ["one", "two"] * 4)
    junk = lambda i: lines(i) if i % 2 else " ".join(f"w{i}x{j}###" for j in range(40))
    rows = [(i, clean(i), "en", f"s{i % 3}", 7) for i in range(1, 900)]
    rows += [(1000 + i, junk(i) if i % 100 < share else clean(i), "en", "bad", 7) for i in range(1, 1201)]
    rows += [(5000 + i, "".join(f"{'z' * 40}{j} " for j in range(12)), "zz", "long", 7) for i in range(300)]  # a language of long words keeps its own
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, DOCS)).collect()}
    bad = {1000 + i for i in range(1, 1201) if i % 100 < share}
    assert {i for i, kept in got.items() if not kept} == bad


def test_word_fences_follow_each_groups_spread(spark):
    groups = {("en", "narrow"): (5000, 1, 100), ("en", "middle"): (5000, 1, 1000), ("en", "wide"): (5000, 3, 1000), ("de", "middle"): (9000, 1, 1000)}
    rows = [(i, at + step * (i % n), *key) for key, (at, step, n) in groups.items() for i in range(2000)]
    stats = spark.createDataFrame(rows, "id long, word_chars long, lang string, source string").selectExpr("*", "1000L n_words", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words")
    got = {(r.lang, r.source): r.long_word for r in quality.fences(stats).collect()}
    assert 6 <= got["en", "narrow"] < got["en", "middle"] - 0.5 < got["en", "wide"] - 1 and got["en", "wide"] <= 1.27 * got["en", "middle"] and 10 < got["de", "middle"] < 12


def test_sketches_merge_exactly(spark):
    stats = spark.range(500).selectExpr("id", "'en' lang", "if(id % 2 = 0, 'a', 'b') source", "100L n_words", "id word_chars", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words")
    both = {tuple(r) for r in quality.merged(quality.sketches(stats), "lang").collect()}
    whole = {tuple(r) for r in quality.merged(quality.sketches(stats.withColumn("source", F.lit("c"))), "lang").collect()}
    assert both == whole
    q = quality.quantiles(quality.merged(quality.sketches(stats), "lang"), "lang").filter("metric = 'long_word'").first()
    assert q.q50 == pytest.approx(2.5, rel=0.02) and q.q75 == pytest.approx(3.74, rel=0.02)


def brute_base(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans():
    rng = np.random.default_rng(3)
    alphabet = list("ab@@..--++  ()0123456789012345é")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("a@b.c_d@e.f 4111 1111 1111 1111 +1 (555) 010-9999 010.2.3.255.9 256.1.1.1") == brute_base("a@b.c_d@e.f 4111 1111 1111 1111 +1 (555) 010-9999 010.2.3.255.9 256.1.1.1")


def test_tagger_on_held_out_sentences():
    model = pii.default_tagger()
    texts, gold = pii.labelled_examples(200, seed=1234)
    hit = found = n = base = 0
    for (own, spans), want in zip(pii.all_spans(texts, model), gold):
        assert set(own) <= set(spans)
        hit, found, n, base = hit + len(set(spans) & set(want)), found + len(spans), n + len(want), base + len(set(own) & set(want))
    assert hit / found > 0.9 and hit / n > 0.9 and base / n < 0.6


def test_windows_are_reconciled():
    model = pii.default_tagger()
    text = ("plain words and so on. " * 17) + "call (030) 123-4567 now " + ("more of the same here. " * 40)
    found = [pii.all_spans(["x" * shift + " " + text], model)[0][1] for shift in range(0, 80, 7)]
    whole = [shift * 7 + 1 + text.index("(030)") for shift, spans in enumerate(found) if spans]
    assert [spans[0][0] for spans in found if spans] == whole and all(len(spans) <= 1 for spans in found)
    assert len(whole) >= 0.8 * len(found)
    assert pii.reconciled([(0, 5, 1, 1.0, True), (3, 9, 1, 1.0, False), (8, 12, 2, 3.0, False)]) == [(8, 12, 2)]


def test_viterbi_against_all_labellings():
    import itertools

    rng = np.random.default_rng(0)
    model = tagger.Tagger((), (), np.zeros(0), np.zeros(0), rng.normal(size=(5, 5)).astype("f"), rng.normal(size=5).astype("f"))
    e = rng.normal(size=(4, 5, 3)).astype("f")
    lengths = np.array([4, 4, 2])
    got = tagger.viterbi(model, e, np.searchsorted(-lengths, -np.arange(4), "left"))
    for c, n in enumerate(lengths):
        best = max(itertools.product(range(5), repeat=int(n)), key=lambda y: model.start[y[0]] + sum(e[t, y[t], c] for t in range(n)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:])))
        assert got[:n, c].tolist() == list(best)


def test_pii_rows_and_redaction(spark):
    rows = [(1, "write to a@b.co or +49 30 1234567890", "en", "s", 36), (2, None, None, None, None), (3, "nothing", "en", "s", 7), (3, "nothing", "en", "s", 7), (4, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = pii.find_pii(df).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert len(got) == 5 and (one.n_email, one.n_phone) == (1, 1) and one.spans == "email:9:15,phone:19:36"
    assert one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest()
    clean = pii.redact(df)
    assert clean.columns == df.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "write to [EMAIL] or [PHONE]", 2: None, 3: "nothing", 4: ""}
    assert pii.find_pii(df.limit(0)).count() == 0


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = ["Don't WE'LL 12ab34 x²", "a<|endoftext|>b", "ΑΣ İstanbul é ", "日本 語　x", "", "naïve café—“ok”…"] * 2
    for ids, text in zip(WordTokenizer(WORDS).encode(pa.array(texts)), texts):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_words_of_letters_are_not_split_and_full_caches_encode_the_same(monkeypatch):
    from tokenizers import Tokenizer

    class Counted:
        seen = []

        def findall(self, text, pattern=word_tokens.PARTS):
            self.seen.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(word_tokens, "PARTS", Counted())
    monkeypatch.setattr(word_tokens, "WORD_CACHE", 3)
    monkeypatch.setattr(word_tokens, "PART_CACHE", 2)
    t, encoder = Tokenizer.from_file(WORDS), WordTokenizer(WORDS)
    texts = ["hello World naïve İstanbul Ĳssel ŉa", "a<|endoftext|>b it's", "hello two, World three", "two, four hello ABC"]
    for text in texts:
        (ids,) = encoder.encode(pa.array([text]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
    assert set(Counted.seen) == {"i̇stanbul", "it's", "two,"} and len(encoder.words) == 6


def test_best_fit():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 101, 400).tolist(), reverse=True)
    spots = packing.pack(lengths, 100, 256)
    fill = {}
    for n, (b, o) in zip(lengths, spots):
        assert fill.get(b, 0) == o
        fill[b] = o + n
    assert max(fill.values()) <= 100 and len(fill) <= 1.05 * math.ceil(sum(lengths) / 100)
    closed = packing.pack([60, 70, 80, 20, 30], 100, 2)  # the fullest of two open bins closes
    assert [b for b, _ in closed] == [0, 1, 2, 2, 0] or [b for b, _ in closed][:3] == [0, 1, 2]


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rows = [(1, "hello world " * 30), (2, None), (3, ""), (4, "x y z"), (4, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.packed_documents(df, WORDS, capacity=16).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 16 * r.piece and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 16 and len(got) == 4 + 4
    pieces = packing.tokenised_pieces(df.filter("doc_id < 4"), WORDS, 16)
    placed = packing.packed(pieces.drop("ids"), 16)
    whole = packing.sequences(placed, pieces).collect()
    assert sum(len(r.ids) for r in whole) == sum(len(ids[i]) for i in (1, 2, 3))
    assert packing.packed_documents(df.limit(0), WORDS).count() == 0


def test_token_counts(spark):
    rows = [(1, "first line\nsecond  line\n\nlast é 日本", "t"), (2, None, None), (3, "", "x"), (4, "x\n" * 5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string")
    for r in token_counts.token_counts(df, BYTES, public_tokenizers.PATTERN, ["title", "text"]).collect():
        assert sum(r.field_tokens) == sum(r.section_tokens) == r.n_tokens and len(r.field_tokens) == 2
    bounds, sections = np.array([0, 3, 5, 9]), np.array([0, 4, 4, 9])
    assert token_counts.attributed(bounds, sections, "start")[0].tolist() == [2, 0, 1]
    assert token_counts.attributed(bounds, sections, "end")[0].tolist() == [1, 0, 2]
    assert token_counts.attributed(np.array([0, 6]), np.array([0, 1, 6]), "majority") [0].tolist() == [0, 1]
    with pytest.raises(ValueError):
        token_counts.attributed(bounds, sections, "none")
    text = "some words in a row " * 50
    assert token_counts.token_bounds(text, BYTES, public_tokenizers.PATTERN).tolist()[-1] == len(text)
    whole = [len(list(p)) for p in token_counts.stretches(text, 70)]
    assert sum(whole) == len(text) and len(whole) > 5


def test_segmentations(spark):
    v = sampled_pieces.vocabulary(PIECES)
    texts = ["", "a", "  two  spaces", "é\n日本語 ☃ \U0001f600", "hello world again"]
    for text, found in zip(texts, sampled_pieces.segmentations(list(enumerate(texts)), v, 4, 7)):
        assert len({ids.tobytes() for ids, *_ in found}) == len(found) >= 1
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        assert all(sampled_pieces.decode(ids.tolist(), PIECES) == text and 0 < score <= 1 for ids, _, _, score in found)
    df = spark.createDataFrame([(1, "hello there"), (1, "hello there"), (2, None)], "doc_id long, text string")
    rows = sampled_pieces.sampled(df, PIECES, 3).collect()
    same = sorted((r["sample"], r.ids_crc32, r.log_prob) for r in rows if r.doc_id == 1)
    assert same[0::2] == same[1::2] and [r.n_pieces for r in rows if r.doc_id == 2] == [0]
    assert sampled_pieces.sampled(df.limit(0), PIECES).count() == 0


def test_rows_of_ids_decode_to_their_texts(spark, tmp_path):
    from skeinwork.llm import queries

    rows = [(1, "def f():\n    return  1 ☃ 日本"), (2, None), (3, ""), (4, " plain words "), (5, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_sampled_pieces(spark, str(tmp_path)).collect()
    assert all(r.text_crc32 == zlib.crc32((dict(rows)[r.doc_id] or "").encode()) and len(r.ids) == r.n_pieces for r in got)
    assert {i: sum(r.doc_id == i for r in got) for i in (1, 2, 3, 4)} == {1: 4, 2: 1, 3: 1, 4: 4}
    df = spark.createDataFrame([(1, None, "old"), (2, [], "old"), (3, sampled_pieces._model(PIECES).encode("hello  there"), "old")], "n int, ids array<int>, text string")
    assert {r.n: r.text for r in sampled_pieces.decoded(df, PIECES).collect()} == {1: None, 2: "", 3: "hello  there"}
    assert sampled_pieces.decoded(df.limit(0), PIECES).count() == 0


def test_usual_segmentations_with_runs_of_spaces_are_in_the_lattice():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    v = sampled_pieces.vocabulary(PIECES)
    assert v.longest >= 16
    for text in ("a   b", "    x", "x  ", "  ", "a\n    b", "a" + " " * 6 + "b"):
        (found,) = sampled_pieces.segmentations([(1, text)], v, 600, 3)
        assert tuple(model.encode(text)) in {tuple(ids.tolist()) for ids, *_ in found}, text
        assert sum(math.exp(log_p) for _, log_p, *_ in found) == pytest.approx(1)
        assert all(sampled_pieces.decode(ids.tolist(), PIECES) == text for ids, *_ in found)
    code = "def f():\n    return 1\n\tif x:  #" + " " * 40 + "end"
    lattice, at, places = sampled_pieces.Lattices(v.units(code), v), 0, {}
    for source, target, piece in zip(lattice.source.tolist(), lattice.target.tolist(), lattice.piece.tolist()):
        places[source, piece] = target
    for i in model.encode(code):
        if not model.is_byte(i):
            at = places[at, i]
        else:  # a byte of a character without a piece
            at = places[at, -1 - ord((" " + code)[at])]
    assert at == len(code) + 1


def test_sampling_without_replacement_has_the_right_law():
    v = sampled_pieces.vocabulary(PIECES)
    n, first, second, probability = 3000, {}, {}, {}
    for found in sampled_pieces.segmentations([(i, "the cat") for i in range(n)], v, 2, 5):
        for seen, (ids, log_p, *_) in zip((first, second), found):
            key = tuple(ids.tolist())
            seen[key] = seen.get(key, 0) + 1
            probability[key] = math.exp(log_p)
    for key, p in probability.items():
        if p > 0.01:
            want = sum(p * q / (1 - q) for k, q in probability.items() if k != key)
            assert first.get(key, 0) / n == pytest.approx(p, abs=0.04)
            assert second.get(key, 0) / n == pytest.approx(want, abs=0.05)


def test_rows_are_sampled_together(monkeypatch):
    v, calls, plain = sampled_pieces.vocabulary(PIECES), [], sampled_pieces.mixed
    monkeypatch.setattr(sampled_pieces, "mixed", lambda x: calls.append(1) or plain(x))
    found = list(sampled_pieces.segmentations([(i, f"some words of row {i} ☃") for i in range(400)], v, 4, 1))
    assert len(calls) < 400 and [len(f) for f in found] == [4] * 400
    for i, samples in enumerate(found):
        assert all(v.decoded(ids) == sampled_pieces.decode(ids.tolist(), PIECES).encode() == f"some words of row {i} ☃".encode() for ids, *_ in samples)


def test_later_sets_count_whatever_is_looked_at_first(monkeypatch):
    v, got = sampled_pieces.vocabulary(PIECES), []
    rows = [(i, " ".join(f"{w}{i * j % 7}" for j, w in enumerate(("the", "another", "tokens", "a") * (5 * i)))) for i in range(30)]
    for first in (1, 32, 5000):
        monkeypatch.setattr(sampled_pieces, "FIRST_SETS", first)
        monkeypatch.setattr(sampled_pieces, "SEARCHED", 100 * first)
        got.append([[(ids.tobytes(), round(log_p, 6), round(value, 6)) for ids, log_p, value, _ in found] for found in sampled_pieces.segmentations(rows, v, 6, 2)])
    assert got[0] == got[1] == got[2] and all(len(found) == 6 for found in got[0][1:])


def test_the_least_number_stays_in_its_unit():
    v = sampled_pieces.vocabulary(PIECES)
    lattices = sampled_pieces.Lattices(["▁another", "▁tokens"], v)
    _, counts, edges = lattices.sample(np.array([1]), np.zeros(1, np.uint64))
    assert counts[0] == len(edges) and v.decoded(lattices.ids(edges)) == b"tokens"
    log_p, _, steps = lattices._walk(np.array([1]), np.array([2**64 - 0x9E3779B97F4A7C15], np.uint64), np.ones(1))  # its first number is 0
    walked = np.concatenate([edge for _, edge in steps])
    assert v.decoded(lattices.ids(walked)) == b"tokens" and walked[0] != lattices.chain_edges[lattices.chain_at[1]]
    assert log_p[0] == pytest.approx(lattices.log_p[walked].sum())
