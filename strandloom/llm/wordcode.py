"""Exact tokenizer ids through a memo of words.

The tokenizer drops white space and never merges across it, so the ids of a text are the
ids of its words one after another.  Words repeat, so each is encoded once for each worker.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Lower-cased words that the tokenizer surely splits into these two runs: letters up to U+00FF, which
#: normalisation leaves alone, then marks.  Without apostrophes, which join short suffixes.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a tokenizer file; its memo serves one task after another, unless
    they ``forget`` it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class WordEncoder:
    """Maps UTF-8 words to id runs.  The memo is emptied once it holds ``memo`` words, which
    bounds memory and changes no result."""

    def __init__(self, path: str, memo: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer, self._memo = Tokenizer.from_file(path), memo
        self._model = self._tokenizer.model
        self._marks: dict[str, list[int]] = {}
        self._clear()

    def forget(self) -> None:
        """Empty the memo."""
        self._clear()

    def _clear(self) -> None:
        self._numbers = _Numbers()
        self._known = 0
        self._start = np.zeros(1024, np.int64)
        self._length = np.zeros(1024, np.int64)
        self._closes = np.zeros(1024, bool)
        self._pool = np.zeros(4096, np.uint32)
        self._used = 0

    def _learn(self, words: list[bytes]) -> None:
        coded = [self._code(w.decode()) for w in words]
        at, sizes = self._known, np.fromiter(map(len, coded), np.int64, len(coded))
        while at + len(words) > len(self._start):
            self._start, self._length, self._closes = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._length, self._closes))
        total = int(sizes.sum())
        while self._used + total > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._start[at : at + len(words)] = self._used + np.cumsum(sizes) - sizes
        self._length[at : at + len(words)] = sizes
        self._closes[at : at + len(words)] = [w[-1:] in b".!?" for w in words]
        self._pool[self._used : self._used + total] = np.fromiter(chain.from_iterable(coded), np.uint32, total)
        self._used += total
        self._known += len(words)

    def _code(self, word: str) -> list[int]:
        plain = _PLAIN.fullmatch(word.lower()) if max(word) <= "\u00ff" else None
        if not plain:
            return self._tokenizer.encode(word, add_special_tokens=False).ids
        letters, marks = plain.groups()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_BYTES)
        out = [x.id for x in self._model.tokenize(letters)]
        if marks:
            if marks not in self._marks:
                if len(self._marks) > 10_000:
                    self._marks.clear()
                self._marks[marks] = [x.id for x in self._model.tokenize(marks)]
            out += self._marks[marks]
        return out

    def _look_up(self, data: bytes) -> np.ndarray:
        if len(self._numbers) > self._memo:
            self._clear()
        words = data.split()
        found = np.fromiter(map(self._numbers.__getitem__, words), np.int64, len(words))
        if len(self._numbers) > self._known:
            new = list(self._numbers)[self._known :] if self._known == 0 else _tail(self._numbers, self._known)
            self._learn(new)
        return found

    def count(self, data: bytes) -> int:
        """Number of ids of a text."""
        found = self._look_up(data)  # may replace the arrays
        return int(self._length[found].sum())

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text, and how many ids lie before the end of each of its sentences."""
        found = self._look_up(data)
        sizes = self._length[found]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self._start[found] - (ends - sizes), sizes) + np.arange(total)
        return self._pool[take], ends[self._closes[found]]


def _tail(numbers: dict, known: int) -> list[bytes]:
    back = reversed(numbers)
    return [next(back) for _ in range(len(numbers) - known)][::-1]
