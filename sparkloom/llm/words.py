"""Words of whole texts as numbers, cut out of Arrow batches byte by byte side by side."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import utf8

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass
class Words:
    """names: the different words (binary); code: each occurrence's word; ends: the n+1 boundaries of the texts; piece:
    equal for neighbours that no break parts."""

    names: pa.Array
    code: np.ndarray
    ends: np.ndarray
    piece: np.ndarray


def split(texts: pa.Array, gaps: bytes = SPACES, breaks: bytes = b"", lower: bool = False) -> Words:
    """Words between `gaps` and `breaks` (ASCII, so no character is cut), A-Z in lower case if wanted; null as empty."""
    raw, off = utf8(texts)
    kind = np.zeros(256, np.int8)
    kind[list(gaps)], kind[list(breaks)] = 1, 2
    of = kind[raw]
    inside = of == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][np.diff(off) > 0]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    before = np.cumsum(inside, dtype=np.int32)[at] - 1
    data = raw[inside]
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts = np.append(before, len(data)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    ends = np.searchsorted(at, off)
    text_of = np.repeat(np.arange(len(off) - 1), np.diff(ends))
    return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), ends, np.cumsum(of == 2, dtype=np.int64)[at] + text_of)
