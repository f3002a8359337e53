"""Word shingles of a text as distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > 150_000:
        _hashes.clear()
    out, digest, known = np.empty(len(words), np.uint64), xxhash.xxh3_64_intdigest, _hashes.get
    for k, w in enumerate(words):
        h = known(w)
        if h is None:
            h = _hashes[w] = digest(w)
        out[k] = h
    return out


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words, A-Z in lower case; a text with
    fewer words is one run; empty without words."""
    h = word_hashes(data.lower().split())
    if not len(h):
        return h
    width = min(size, len(h))
    run = np.full(len(h) - width + 1, np.uint64(width))
    for j in range(width):
        run = run * _MULTIPLIER + h[j : j + len(run)]
    run = (run ^ (run >> np.uint64(31))) * _MIX
    run.sort()
    return run[np.concatenate([[True], run[1:] != run[:-1]])]
