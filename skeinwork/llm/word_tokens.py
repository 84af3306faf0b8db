"""Whole-text encoding with a word-level BPE file, through a bounded cache of words.

The tokenizer drops white space and never joins across it, so a text's ids are those of its
white-space words, one after the other. Frequent words come from the cache; the others are encoded by
the tokenizer itself, in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: A full cache keeps what it has; further words are then encoded for each batch of texts.
WORD_CACHE = 500_000
PART_CACHE = 500_000
#: Texts of these characters only have parts that Python's lower() and this pattern find as the tokenizer does.
SIMPLE = re.compile(r"[\t-\r -~À-ÖØ-öø-ıĲ-ňŊ-žƀ–—‘’“”…€]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ıĲ-ňŊ-žƀ]+|[0-9]|[^\sa-z0-9ß-öø-ıĲ-ňŊ-žƀ]+")
WORDS = re.compile(r"[^ \t-\r]+")
#: White space for str.split() only.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Cache(dict):
    """ids of words; those that aren't kept come from ``others``."""

    others: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.others[word]


class WordTokenizer:
    """Encodes texts to ids; ``path`` is a file of the tokenizers library whose words end in ``</w>``."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        assert max(vocabulary.values()) < 65536
        self.ends = np.zeros(65536, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Cache()
        self.parts: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Many parts in one text: each ends with a token of the form ``...</w>``."""
        found: dict[str, bytes] = {}
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            ids = self._raw([" ".join(some)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, begin = ids.tobytes(), 0
                for part, stop in zip(some, (stops * 2).tolist()):
                    found[part] = raw[begin:stop]
                    begin = stop
            else:
                for part, one in zip(some, self._raw(some)):
                    found[part] = one.tobytes()
        return found

    def _encode_words(self, missing: list[str]) -> dict[str, bytes]:
        together = " ".join(missing)
        special = [s for s in self.special if s in together]
        simple = [w for w in missing if SIMPLE.fullmatch(w) and not (special and any(s in w for s in special))]
        # a word of letters is one part
        split = [(low,) if low.isalpha() else PARTS.findall(low) for low in map(str.lower, simple)]
        fresh = list(set(chain.from_iterable(split)).difference(self.parts))
        ids = self._encode_parts(fresh)
        if len(self.parts) < PART_CACHE:
            self.parts |= ids
            ids = self.parts
        else:
            ids |= {p: self.parts[p] for p in set(chain.from_iterable(split)).intersection(self.parts)}
        found = {word: ids[own[0]] if len(own) == 1 else b"".join(map(ids.__getitem__, own)) for word, own in zip(simple, split)}
        odd = list(set(missing).difference(found))
        found |= {word: ids.tobytes() for word, ids in zip(odd, self._raw(odd) if odd else ())}
        if len(self.words) < WORD_CACHE:
            self.words |= found
        return found

    def encode(self, column: pa.Array, most: int = 4_000_000) -> Iterator[np.ndarray]:
        """ids of each text, in order; null is empty."""
        held: list[list[str]] = []
        size = 0
        for value in column:
            text = value.as_py() or ""
            held.append(WORDS.findall(text) if OTHER_SPACE.search(text) else text.split())
            size += len(text)
            if size > most:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        all_words = set().union(*held) if held else set()
        missing = list(all_words.difference(self.words))
        self.words.others = self._encode_words(missing) if missing else {}
        for words in held:
            yield np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u2").astype(np.uint32)
