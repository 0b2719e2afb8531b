"""Content-defined anchors: in every window of WIN bytes the GRAM-byte string with the least hash.

Equal windows have equal anchors at equal offsets, whatever surrounds them, so what repeats can be found from the
anchors, some 3 % of the positions, alone.
"""

from __future__ import annotations

import numpy as np

WIN, GRAM = 100, 32
SPAN = WIN - GRAM  # an anchor's windows start at most this far before it
_RNG = np.random.Generator(np.random.PCG64(4242))
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9FB21C651E98DF25
_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 21), np.uint64(base), np.uint64)]))
        _powers[str(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any range of a byte string, from one pass."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _power(_P, n)[:n], out=self.sum[1:])
        self.inverse = _power(_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def grams(self, width: int) -> np.ndarray:
        return mix((self.sum[width:] - self.sum[:-width]) * self.inverse[: len(self.sum) - width])


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, the text each is in, gram hashes, and hashes of what all windows around an anchor cover."""
    none = np.zeros(0, np.int64)
    if len(raw) < WIN:
        return none, none, none, none
    h = Hashes(raw)
    gram = h.grams(GRAM)
    bits = np.uint64(max(20, int(len(raw)).bit_length()))
    key = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    width, low = 1, key
    while 2 * width <= SPAN + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    # windows that lie inside one text
    inside = np.zeros(len(low) + 1, np.int64)
    starts, ends = off[:-1], off[1:]
    ok = ends - starts >= WIN
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, np.minimum(ends[ok] - WIN + 1, len(low)), -1)
    low = low[np.cumsum(inside[:-1]) > 0]
    chosen = np.zeros(len(gram), bool)
    chosen[(low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    text = np.searchsorted(off, at, "right") - 1
    left, right = np.maximum(off[text], at - SPAN), np.minimum(off[text + 1], at + WIN)
    region = h.of(left, right) + (at - left).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return at, text, gram[at].view(np.int64), region.view(np.int64)
