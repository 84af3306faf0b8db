"""Personal data: fixed patterns, and spans that a character-level tagger adds.

The tagger is trained on the driver from labelled spans: a bounded, seeded set of made-up sentences
(``EXAMPLES``), so that the weights don't depend on the corpus. Each text is cut into overlapping
windows; all windows of a batch are decoded together, and a text's spans are reconciled globally: of
all windows' spans the non-overlapping set with the highest sum of scores stays. A span that a window's
edge cuts counts only where no neighbour saw it whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.llm.shared import plain
from skeinwork.llm.tagger import KINDS, OVERLAP, WINDOW, Tagger, classes, fit, tag_windows

EXAMPLES = 3000
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELT_EMAIL = re.compile(r"[\w.%+-]+(?:\s*(?:@|\(at\)|\[at\])\s*[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]+)+|\sat\s[\w-]+(?:\sdot\s[\w-]+)+)")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        d = int(digit) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _AFTER_AT.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end(), "email"
            free = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, leftmost and non-overlapping within a kind, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def labelled_examples(n: int = EXAMPLES, seed: int = 11) -> tuple[list[str], list[list[Span]]]:
    """Made-up sentences with labelled personal data, in usual and unusual spellings, and look-alikes without a label."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[rng.integers(len(options))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllables = ["the", "an", "er", "on", "ti", "re", "st", "en", "ha", "ou", "ne", "lo", "mi", "ka", "zu", "ch", "ge", "que", "ió", "é", "ü"]
    word = lambda: "".join(pick(*syllables) for _ in range(rng.integers(1, 5)))
    letters = "eeeettaaoinshrdlucmfwypvbgkéèüöñßç"
    free = lambda: "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(2, 14)))

    def prose() -> str:
        """A stretch of plain or noisy text without any label."""
        noise = pick("", "", "", "", "###", "$$$", "%%%", "&&&", "***", "!!", " |")
        words = [pick(word, free, lambda: pick("at", "on", "an", "dot", "in", "the"))() + noise for _ in range(rng.integers(6, 30))]
        words = [w.upper() for w in words] if rng.random() < 0.1 else words
        return "".join(w + pick(" ", " ", " ", " ", ", ", ". ", ".\n") for w in words).capitalize()

    def email() -> str:
        user, host, end = word() + pick("", ".", "_", "-") + word(), word(), pick("com", "org", "net", "de", "fr")
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "))
        return f"{user}{at}{host}{dot}{end}"

    def ip() -> str:
        if rng.random() < 0.25:
            return ":".join(f"{x:x}" for x in rng.integers(16, 65536, 8))
        return pick(".", ".", ".", " . ", "[.]").join(str(x) for x in rng.integers(0, 256, 4))

    def card() -> str:
        digits = pick("4", "5") + number(14)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return pick(" ", "-", "", ".", "/").join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return pick(f"+{number(2)} {number(3)} {number(3)} {number(4)}", f"+1-{number(3)}-{number(3)}-{number(4)}", f"+{number(11)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"00{number(2)} {number(2)} {number(7)}", f"0{number(3)}/{number(7)}")

    def other() -> str:
        return pick(number(4), number(2) + "." + number(2) + "." + number(4), f"{number(1)}.{number(1)}.{number(2)}", f"${number(3)}.{number(2)}", f"{number(4)}-{number(2)}-{number(2)}", f"#{number(5)}", "| " + word() + " |", word() + "### ", f"{number(2)}:{number(2)}", "at " + word(), word() + "_" + word(), f"v{number(1)}.{number(2)}")

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    texts, spans = [], []
    for _ in range(n):
        text, found = "", []
        for _ in range(rng.integers(1, 4)):
            if rng.random() < 0.35:
                text += prose()
            words = " ".join(word() for _ in range(rng.integers(2, 9)))
            text += words.capitalize() + pick(" ", " ", ", ", ": ", ".\n")
            if rng.random() < 0.55:
                kind = pick(*KINDS)
                value = makers[kind]()
                found.append((len(text), len(text) + len(value), kind))
                text += value + pick(" ", ".", ", ", "\n", ") ")
            elif rng.random() < 0.6:
                text += other() + pick(" ", ". ", ", ")
        texts.append(text + ". ")
        spans.append(found)
    return texts, spans


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return fit(*labelled_examples())


def plausible(text: str, kind: str) -> bool:
    """An exact check of what the tagger found."""
    digits = len(_digits(text))
    if kind == "email":
        return bool(_SPELT_EMAIL.fullmatch(text))
    if kind == "ip":
        parts = [p for p in re.split(r"[^0-9A-Fa-f]+", text) if p]
        return len(parts) == 8 if ":" in text else len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= digits <= 19 and luhn(_digits(text)) and not re.search("[^0-9 ./-]", text)
    return 7 <= digits <= 15 and not re.search("[A-Za-z]", text)


def reconciled(candidates: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """(start, end, label, score, cut) of all windows -> the non-overlapping spans with the highest sum of scores.

    A cut span stays out if a whole one overlaps it; of equal spans one counts. Ties go to the earlier span.
    """
    whole = sorted({c[:3]: c for c in candidates if not c[4]}.values())
    ends = [c[1] for c in sorted(whole, key=lambda c: c[1])]
    starts = [c[0] for c in whole]
    loose = [c for c in candidates if c[4] and bisect_right(starts, c[1] - 1) - bisect_right(ends, c[0]) <= 0]
    spans = sorted({c[:3]: c for c in [*whole, *loose]}.values(), key=lambda c: (c[1], c[0], c[2]))
    stops = [s[1] for s in spans]
    best, take = [0.0], []
    for k, (a, b, _, score, _cut) in enumerate(spans):
        prior = bisect_right(stops, a, 0, k)
        worth = best[prior] + max(score, 1e-6) * (b - a)
        take.append((worth > best[k], prior))
        best.append(max(best[k], worth))
    out, k = [], len(spans)
    while k:
        chosen, prior = take[k - 1]
        if chosen:
            out.append(spans[k - 1][:3])
            k = prior
        else:
            k -= 1
    return out[::-1]


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text: the base spans, and all spans. The tagger reads every character of every text."""
    windows, owner = [], []
    for i, text in enumerate(texts):
        x = classes(text)
        for at in range(0, max(1, len(x) - OVERLAP), WINDOW - OVERLAP):
            windows.append(x[at : at + WINDOW])
            owner.append((i, at))
    added: dict[int, list] = {}
    for (i, at), window, spans in zip(owner, windows, tag_windows(tagger, windows)):
        for a, b, label, score in spans:
            cut = (a == 0 and at > 0) or (b == len(window) and at + b < len(texts[i]))
            added.setdefault(i, []).append((at + a, at + b, label, score, cut))
    out = []
    for i, text in enumerate(texts):
        base = base_spans(text)
        more = []
        taken = sorted((a, b) for a, b, _ in base)
        for a, b, label in reconciled(added.get(i, [])):
            value = text[a:b]
            a, b = a + len(value) - len(value.lstrip()), b - len(value) + len(value.rstrip())
            clear = all(y <= a or x >= b for x, y in taken)
            if b > a and clear and plausible(text[a:b], KINDS[label - 1]):
                more.append((a, b, KINDS[label - 1]))
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _groups(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    begin, held, size = 0, [], 0
    for k, value in enumerate(batch.column("text")):
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size > most or k + 1 == batch.num_rows:
            yield batch.slice(begin, k + 1 - begin), held
            begin, held, size = k + 1, [], 0


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all.

    Null text is empty and has none; repeated rows are treated alike; offsets are code points, ends exclusive;
    an empty table gives no rows; other columns are ignored.
    """
    model = tagger or default_tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _groups(batch):
                found = all_spans(texts, model)
                counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
                digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("id").cast(pa.int64()), *counts, digests, pa.array([joined(spans) for _, spans in found], pa.string())], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return plain(docs, id=id_col, text=text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in brackets; overlapping spans are one, named by the first. Null stays null."""
    model = tagger or default_tagger()
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _groups(pa.RecordBatch.from_arrays([*batch.columns, batch.column(place)], names=[*[f"c{i}" for i in range(batch.num_columns)], "text"])):
                clean = []
                for text, was, (_, spans) in zip(texts, rows.column(place), all_spans(texts, model)):
                    parts, end = [], 0
                    for a, b, kind in spans:
                        if a >= end:
                            parts += [text[end:a], f"[{kind.upper()}]"]
                        end = max(end, b)
                    clean.append("".join(parts) + text[end:] if was.is_valid else None)
                columns = [pa.array(clean, pa.string()) if i == place else rows.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([f if i != place else pa.field(f.name, pa.string()) for i, f in enumerate(batch.schema)]))

    return docs.mapInArrow(run, docs.schema)
