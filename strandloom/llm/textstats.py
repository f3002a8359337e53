"""Statistics of one text, from its UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
WINDOW_WORDS = 8

_CONTINUES = slice(0x80, 0xC0)
_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def number_words(words: list[bytes]) -> np.ndarray:
    """Each word's number by first appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))


def repeated_words(numbers: np.ndarray, width: int = WINDOW_WORDS) -> int:
    """Words inside windows of ``width`` words (a power of two) that occur twice or more.

    Windows are named exactly, by pairing the names of their halves; it ends early once all
    windows of a smaller width differ."""
    names, step = numbers, 1
    while step < width:
        if len(names) <= step:
            return 0
        _, names, times = np.unique(names[:-step] * (int(names.max()) + 1) + names[step:], return_inverse=True, return_counts=True)
        if len(times) == len(names):
            return 0
        step *= 2
    edge = np.zeros(len(numbers) + 1, np.int64)
    hit = np.flatnonzero(times[names] > 1)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines that hold a word, and how many of them equal an earlier one."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def base_counts(data: bytes, words: list[bytes], numbers: np.ndarray, counts: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = int(counts.sum() - counts[_CONTINUES].sum())
    return len(words), chars - int(counts[SPACE].sum()), int(counts[SYMBOLS].sum()), duplicate_lines(data)[1], repeated_words(numbers)


STATISTICS = (
    "log_words", "word_length", "symbols", "digits", "capitals", "punctuation", "beyond_ascii", "spaces", "distinct_words", "top_word",
    "distinct_pairs", "top_pair", "repeated", "log_lines", "line_words", "duplicate_lines", "closed_lines", "byte_entropy", "short_words", "long_words",
)


def statistics(data: bytes) -> list[float]:
    """The values of ``STATISTICS``; all 0 for a text without words."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts, numbers = byte_counts(data), number_words(words)
    _, word_chars, symbols, _, repeats = base_counts(data, words, numbers, counts)
    lines, twice = duplicate_lines(data)
    times = np.bincount(numbers)
    pair_times = np.unique(numbers[:-1] * len(times) + numbers[1:], return_counts=True)[1] if n > 1 else np.ones(1, np.int64)
    chars = max(1, int(counts.sum() - counts[_CONTINUES].sum()))
    share = counts[counts > 0] / len(data)
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)), word_chars / n, symbols / chars, counts[48:58].sum() / chars, counts[65:91].sum() / chars, counts[_PUNCTUATION].sum() / chars,
        counts[0xC0:].sum() / chars, counts[SPACE].sum() / chars, len(times) / n, times.max() / n, len(pair_times) / max(1, n - 1), pair_times.max() / max(1, n - 1),
        repeats / n, float(np.log1p(lines)), n / lines, twice / lines, data.count(b".\n") / lines, float(-(share * np.log2(share)).sum()),
        np.count_nonzero(sizes <= 2) / n, np.count_nonzero(sizes >= 12) / n,
    ]
