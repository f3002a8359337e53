"""Run-length index of a small text collection, and its matching statistics.

The suffixes of all segments are sorted by prefix doubling, each segment ended by its own
mark.  The Burrows-Wheeler transform of that order is run-compressed: only the suffixes at
the first and last place of each run are sampled, with the length that they share with the
suffix before or after them.  Where the transform repeats, the shared length of a suffix is
one less than that of the suffix one byte to the left, so streaming the text once from left
to right restores the statistics of every position from the samples.
"""

from __future__ import annotations

import numpy as np

_FIRST = 7  # symbols of nine bits that one 63-bit key holds


class RunIndex:
    """``text``: the bytes of all segments, ``ends``: where each segment ends."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        n = len(text)
        self.n = n
        self.left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # bytes to the end of the segment
        self.text = text
        self.ranks: list[tuple[int, np.ndarray]] = []
        key = np.zeros(n, np.int64)
        for k in range(_FIRST):
            symbol = np.zeros(n, np.int64)
            symbol[: max(0, n - k)] = text[k:]
            key = key << 9 | np.where(self.left > k, symbol + 1, 0)
        width, longest = _FIRST, int(self.left.max(initial=0))
        while True:
            order = np.argsort(key)
            new = np.empty(n, bool)
            new[:1] = True
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32)
            self.ranks.append((width, rank))
            if width >= longest or new.all():
                break
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - width)] = rank[width:]
            key = rank.astype(np.int64) * (n + 1) + np.where(self.left > width, follow, 0)
            width *= 2
        suffixes = np.argsort(rank.astype(np.int64) * n + np.arange(n))
        before = np.where(suffixes > 0, text[suffixes - 1].astype(np.int32), -1)
        starts = np.zeros(n + 1, bool)
        starts[0] = True
        starts[ends] = True
        before = np.where(starts[suffixes], -1 - suffixes, before)  # each segment's mark is a symbol of its own
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if n else np.zeros(0, np.int64)
        tails = np.concatenate([heads[1:] - 1, [n - 1]]) if n else heads
        shared = np.zeros(len(heads) + 1, np.int64)
        if len(heads) > 1:
            shared[1:-1] = self.common(suffixes[heads[1:] - 1], suffixes[heads[1:]])
        #: The run-compressed transform, and the sampled suffixes of run ends with what they share.
        self.symbols, self.lengths = before[heads], np.diff(np.append(heads, n))
        self.head_suffix, self.head_shared = suffixes[heads], shared[:-1]
        self.tail_suffix, self.tail_shared = suffixes[tails], shared[1:]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of pairs of suffixes."""
        limit = np.minimum(self.left[a], self.left[b])
        at = np.zeros(len(a), np.int64)
        levels = self.ranks[::-1]
        first = True
        for width, rank in levels:
            while True:
                can = np.flatnonzero(at + width <= limit)
                same = can[rank[a[can] + at[can]] == rank[b[can] + at[can]]]
                at[same] += width
                if not first or not len(same):
                    break
            first = False
        for _ in range(_FIRST - 1):
            can = np.flatnonzero(at < limit)
            same = can[self.text[a[can] + at[can]] == self.text[b[can] + at[can]]]
            if not len(same):
                break
            more = np.zeros(len(a), bool)
            more[same] = True
            limit = np.where(more, limit, at)
            at[same] += 1
        return at

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest prefix of its suffix that also starts elsewhere."""
        place = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for suffix, shared in ((self.head_suffix, self.head_shared), (self.tail_suffix, self.tail_shared)):
            sample = np.full(self.n, -1, np.int64)
            sample[suffix] = shared
            last = np.maximum.accumulate(np.where(sample >= 0, place, 0))
            np.maximum(out, sample[last] - (place - last), out=out)
        return out
