"""Sets of word-shingle hashes for whole batches of texts, in numpy.

Words are the runs of bytes other than space and 09-0D after lower-casing A-Z. A set holds the distinct shingles of
`width` consecutive words as 64-bit hashes; a text with fewer words has its whole sequence as one, a text without
words the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import utf8

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _RNG.integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9FB21C651E98DF25)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, in order, and the n+1 boundaries between the texts."""
    word = ~_SPACE[raw]
    head = word.copy()
    head[1:] &= ~word[:-1]
    inner = off[1:-1][(off[1:-1] < len(raw)) & (off[1:-1] > 0)]
    head[inner] = word[inner]  # a text starts a word even where the one before ends without a space
    start = np.flatnonzero(head)
    bounds = np.searchsorted(start, off)
    if not len(start):
        return np.zeros(0, np.uint64), bounds
    at = np.flatnonzero(word)
    first = np.searchsorted(at, start)
    place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()), _POWER)]))
    return mix(np.add.reduceat(_BYTE[raw[at]] * power[place], first) + np.diff(first, append=len(at)).astype(np.uint64)), bounds


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted set of each text."""
    words, to = word_hashes(*utf8(texts))
    n = np.diff(to)
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width if len(whole) else 0):
        whole += words[j : j + len(whole)] * _PLACE[j]
    whole = mix(whole)
    out = []
    for k, s in enumerate(to[:-1].tolist()):
        if n[k] >= width:
            out.append(np.unique(whole[s : s + n[k] - width + 1]))
        else:
            out.append(mix(np.array([(words[s : s + n[k]] * _PLACE[: n[k]]).sum() + np.uint64(n[k])], np.uint64)) if n[k] else np.zeros(0, np.uint64))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
