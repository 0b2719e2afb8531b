"""Periodic runs of words: where a text says the same thing four times over.

Runs are found in linear time on an ordered alphabet. Two passes, one for each direction of the order, compute the Lyndon
array (every suffix's next smaller suffix) from left to right with a stack; every run is a Lyndon word that repeats, so its
period is the distance from a suffix to its next smaller one. How far two suffixes match is stored with each pair that is
compared, and a comparison inside a stretch that matched before takes over the stored value of the pair it mirrors and goes
on behind the stretch, so no word is matched twice. There is no suffix array or tree, and nothing is hashed: words are
numbered exactly, and any total order of these numbers gives the same runs.

Defined results: a null, empty or blank text has no run, four nulls and the hashes of nothing. Texts of any length are taken
whole, in one task; memory is some hundred bytes a word of the longest one. Rows that repeat a doc_id each give their row. A
null doc_id is never altered. An empty table gives an empty one. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .common import slices

Run = tuple[int, int, int]  # start, length, period
BATCH_BYTES = 4_000_000


def _matches(w: list[int], n: int) -> list[Run]:
    """(l, d, k): suffix l's next smaller suffix is l + d and matches it in k >= 2 d words. w ends in -1 at place n."""
    nxt, nxt_k, prv, prv_k = [n] * n, [0] * n, [-1] * n, [0] * n
    found: list[Run] = []
    right = reach = shift = 0  # text[right:reach] equals what stands `shift` words before it
    for r in range(1, n):
        l, k, b = r - 1, 0, w[r]
        # most words differ from the first on: the stack falls to the first smaller word
        while l >= 0 and (a := w[l]) > b:
            nxt[l] = r
            while prv_k[l]:  # the next one matches this one, so it is as much larger
                l = prv[l]
                nxt[l] = r
            l = prv[l]
        if l < 0:
            continue
        if a < b:
            prv[r] = l
            continue
        while True:
            a, b = w[l + k], w[r + k]
            if a == b:
                k += 1
                if r + k < reach and l >= right:
                    x, y = l - shift, r - shift
                    m = nxt_k[x] if nxt[x] == y else prv_k[y] if prv[y] == x else 0
                    if m > k:
                        k = min(m, reach - r)
                while w[l + k] == w[r + k]:
                    k += 1
                if r + k > reach:
                    right, reach, shift = r, r + k, r - l
                a, b = w[l + k], w[r + k]
            if a < b:
                prv[r], prv_k[r] = l, k
                break
            nxt[l], nxt_k[l] = r, k
            if k and k >= 2 * (r - l):
                found.append((l, r - l, k))
            m, l = prv_k[l], prv[l]
            if l < 0:
                break
            if m < k:  # the next one on the stack differs from the last where that still matched
                prv[r], prv_k[r] = l, m
                break
    return found


def runs(code: list[int], times: int = 4, least: int = 6) -> list[Run]:
    """All runs (start, length, period) of at least `least` words and `times` >= 4 periods, by start, then period."""
    n = len(code)
    if n < least:
        return []
    top, seen, out = max(code), set(), []
    for w in (code, [top - c for c in code]):
        for l, p, k in _matches([*w, -1], n):
            end = l + p + k
            if (p, end) in seen:  # another root of a run that is known
                continue
            seen.add((p, end))
            s = l
            while s and code[s - 1] == code[s - 1 + p]:
                s -= 1
            if end - s >= max(least, times * p):
                out.append((s, end - s, p))
    return sorted(out, key=lambda x: (x[0], x[2]))


def altered(code: np.ndarray, doc_id: int | None) -> np.ndarray:
    """One document of ten, told by its id's checksum, goes on with the same words from some place on."""
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(code)
    if h % 10 or not n:
        return code
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(a, n)
    return np.concatenate([code[:a], code[a + (i - a) % p]])


def dropped(found: list[Run], n: int) -> np.ndarray:
    """Words that some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, length, p in found:
        change[s + p] += 1
        change[s + length] -= 1
    return np.cumsum(change)[:-1] > 0


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digest(docs: DataFrame, alter: bool = True) -> DataFrame:
    """A row a document: its runs, the longest of them, and digests of all runs and of the text without their repeats."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            parts = words.split(b.column("text"))
            names = parts.names.to_pylist()
            rows = []
            for doc_id, s, e in zip(b.column("doc_id").to_pylist(), parts.ends[:-1].tolist(), parts.ends[1:].tolist()):
                code = altered(parts.code[s:e], doc_id) if alter else parts.code[s:e]
                found = runs(code.tolist())
                best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
                kept = code[~dropped(found, len(code))] if found else code
                told = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((doc_id, len(found), *top, sha256(told.encode()).hexdigest(), sha256(b" ".join([names[c] for c in kept.tolist()])).hexdigest()))
            cols = list(zip(*rows))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(find, SCHEMA)
