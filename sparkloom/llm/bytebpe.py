"""Byte-level BPE, encoding and decoding, with a segment tree over the bytes of a piece.

A leaf stands for the byte a token starts at and holds the rank of this token's pair with its right neighbour; the root tells
the smallest rank and, of equal ones, the leftmost. A merge updates three leaves (the merged token's, its left neighbour's,
the swallowed one's) and their ancestors, so a piece of n bytes takes n log n steps however long it is. Different short pieces
of a batch are merged side by side, a tree a row; long ones each in a tree of their own. Both give the same ids.

Defined results: a null or empty text has no id. Texts and pieces of any length are encoded whole. Rows that repeat a doc_id
each give their row; an empty table gives an empty one; further columns are ignored. Text that looks like a special token is
ordinary text. Ids decode to the text's bytes exactly, since every byte has a rank (checked when ranks are read).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, utf8

#: Pieces a worker remembers before it starts afresh, bytes up to which one is remembered or merged beside others, and bytes
#: of text that are encoded at a time.
CACHE_PIECES, SHORT, BATCH_BYTES = 600_000, 256, 4_000_000
_NONE = np.int64(1) << 60


class Ranks:
    """Token bytes and, for two tokens, the rank of what they merge to (which is its id)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.single = np.array([self.of[bytes([b])] for b in range(256)], np.int64)  # KeyError: not byte-level
        self.size = max(self.of.values()) + 1
        self.token = [b""] * self.size
        for token, rank in self.of.items():
            self.token[rank] = token
        get = self.of.get
        pairs = sorted((a * self.size + b, rank) for token, rank in self.of.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None)
        self.pairs = dict(pairs)
        self.keys, self.ranks = (np.array(x, np.int64) for x in zip(*pairs))
        # what two single bytes merge to, by their values
        self.of_bytes = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair; _NONE where a token is missing (negative) or the pair has no rank."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.ranks[at], _NONE)


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece by its own tree; a node holds (rank, place) as one number."""
    n = len(piece)
    width = 1 << max(n - 1, 1).bit_length()
    tok = ranks.single[np.frombuffer(piece, np.uint8)].tolist()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    pair, size, none = ranks.pairs.get, ranks.size, int(_NONE)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = pair(tok[i] * size + tok[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        while node > 1:
            node >>= 1
            value = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == value:
                break
            tree[node] = value

    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        gone = nxt[i]
        after = nxt[gone]
        tok[i], tok[gone], nxt[i] = rank, -1, after
        put(gone, none)
        found = None
        if after < n:
            prv[after] = i
            found = pair(rank * size + tok[after])
        put(i, none if found is None else found * width + i)
        before = prv[i]
        if before >= 0:
            found = pair(tok[before] * size + rank)
            put(before, none if found is None else found * width + before)
    return [t for t in tok if t >= 0]


def merge_rows(pieces: list[bytes], width: int, ranks: Ranks) -> list[list[int]]:
    """Ids of pieces of up to `width` bytes (a power of two), each in its own row and tree."""
    rows, length = len(pieces), np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
    place = np.arange(width)
    # a column more than places: what would lie behind the end, or before the start
    tok = np.full((rows, width + 1), -1, np.int64)
    tok[:, :width] = np.where(place < length[:, None], ranks.single[raw], -1)
    nxt = np.tile(np.arange(1, width + 2), (rows, 1))
    nxt[:, width] = width
    prv = np.tile(np.arange(-1, width), (rows, 1))
    tree = np.full((rows, 2 * width), _NONE, np.int64)
    key = lambda rank, at: np.where(rank < _NONE, rank * width + at, _NONE)
    first = ranks.of_bytes[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]]
    tree[:, width : 2 * width - 1] = key(np.where(place[1:] < length[:, None], first, _NONE), place[:-1])
    half = width
    while half > 1:
        half //= 2
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
    live = np.flatnonzero(tree[:, 1] < _NONE)
    while len(live):
        rank, i = np.divmod(tree[live, 1], width)
        gone = nxt[live, i]
        after, before = nxt[live, gone], prv[live, i]
        tok[live, i], tok[live, gone], nxt[live, i], prv[live, after] = rank, -1, after, i
        nodes = []
        for at, found in ((gone, np.full(len(live), _NONE)), (i, ranks.rank(rank, tok[live, after])), (before, ranks.rank(tok[live, before], rank))):
            has = at >= 0
            lane, spot = live[has], at[has]
            tree[lane, width + spot] = key(found[has], spot)
            nodes.append((lane, width + spot))
        lane, node = np.concatenate([x[0] for x in nodes]), np.concatenate([x[1] for x in nodes])
        half = width
        while half > 1:
            half //= 2
            node = node >> 1
            tree[lane, node] = np.minimum(tree[lane, 2 * node], tree[lane, 2 * node + 1])
        live = live[tree[live, 1] < _NONE]
    kept = tok[:, :width] >= 0
    ids = tok[:, :width][kept].tolist()
    to = np.cumsum(kept.sum(1)).tolist()
    return [ids[s:e] for s, e in zip([0, *to[:-1]], to)]


#: Fixed value: the pattern that cut() follows by classes of characters; any other one is matched as it is.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@cache
def classes() -> np.ndarray:
    """Letter, number, white space or other, of every code point."""
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every, out = "".join(map(chr, points)), np.zeros(0x110000, np.int8)
    for of, kind in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(kind, every):
            out[points[m.start()] : points[m.end() - 1] + 1] = of
    out[0xD800:0xE000] = _OTHER
    return out


def cut(texts: pa.Array, pattern: str = PATTERN) -> tuple[pa.Array, np.ndarray]:
    """All matches of the pattern as one binary array, and the n+1 boundaries of the texts; null as empty."""
    if pattern != PATTERN:
        found = [regex.findall(pattern, t) if t else [] for t in texts.to_pylist()]
        return pa.array([p.encode() for ps in found for p in ps], pa.binary()), np.concatenate([[0], np.cumsum([len(ps) for ps in found])])
    raw, off = utf8(texts)
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(len(off), np.int64)
    head = np.flatnonzero(raw & 0xC0 != 0x80)  # bytes that characters start at
    ch = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(ch)
    of = classes()[ch]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[np.searchsorted(head, off)] = True
    space = of == _SPACE
    start = edge[:-1].copy()
    start[1:] |= of[1:] != of[:-1]
    last = np.append(start[1:], True)  # of its run
    # the last of white space before something else parts from the rest; a blank then belongs to what follows
    parted = space & last & ~edge[1:]
    start |= parted
    joins = parted & (ch == 32)
    start[1:] &= ~joins[:-1]
    # an apostrophe alone, not joined to a blank, before one of the endings: their end is a boundary, their start isn't
    lone = np.flatnonzero((ch == 39) & start & last & ~edge[1:])
    if len(lone):
        at = lambda k: np.where(lone + k < n, ch[np.minimum(lone + k, n - 1)], 0)
        one, two = at(1), at(2)
        inside = ~edge[np.minimum(lone + 2, n)]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)) & inside, 2, size)
        lone, size = lone[size > 0], size[size > 0]
        start[lone + 1] = False
        to = lone + 1 + size
        start[to[to < n]] = True
    at = np.flatnonzero(start)
    bounds = np.append(head[at], len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]), np.searchsorted(bounds[:-1], off)


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of start[0], .. start[0] + count[0] - 1, start[1], .. one after another."""
    to = np.cumsum(count)
    return np.repeat(start - to + count, count) + np.arange(to[-1] if len(to) else 0)


class Store:
    """Short arrays laid end to end."""

    def __init__(self, items: list, kind: type):
        self.count = np.fromiter(map(len, items), np.int64, len(items))
        self.start = np.cumsum(self.count) - self.count
        self.flat = np.frombuffer(b"".join(items), kind) if kind is np.uint8 else np.fromiter(chain.from_iterable(items), kind, int(self.count.sum()))

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays chosen, end to end, and their n+1 boundaries."""
        count = self.count[which]
        return self.flat[spans(self.start[which], count)], np.concatenate([[0], np.cumsum(count)])


class Codec:
    """Ids of texts and bytes of ids. Every match of the pattern is a piece of its own; a piece that has a rank is one token."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.ranks, self.pattern = Ranks(path), pattern
        self.bytes_of = Store(self.ranks.token, np.uint8)
        self.spelt = Store([b"%d," % i for i in range(self.ranks.size)], np.uint8)
        self.known: dict[bytes, list[int]] = {}

    def merged(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        out, groups = {}, {}
        for raw in pieces:
            whole = self.ranks.of.get(raw)
            if whole is not None:
                out[raw] = [whole]
            elif len(raw) > SHORT:
                out[raw] = merge_long(raw, self.ranks)
            else:
                groups.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append(raw)
        for width, some in groups.items():
            step = max(1, 400_000 // width)
            for s in range(0, len(some), step):
                part = some[s : s + step]
                out.update(zip(part, merge_rows(part, width, self.ranks)))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n+1 boundaries of the texts."""
        pieces, ends = cut(texts, self.pattern)
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        new = self.merged(p for p in names if p not in self.known)
        self.known.update((p, ids) for p, ids in new.items() if len(p) <= SHORT)
        known = self.known
        ids, bounds = Store([known[p] if p in known else new[p] for p in names], np.int64).of(coded.indices.to_numpy())
        return ids, bounds[ends]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the n+1 boundaries of the texts."""
        raw, at = self.bytes_of.of(ids)
        return raw, at[bounds]


@cache
def codec(path: str, pattern: str = PATTERN) -> Codec:
    """One for each worker process and vocabulary."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            ids, bounds = codec(path, pattern).encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, text (binary) of doc_id, ids; null ids as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids").to_pylist()
            bounds = np.cumsum([0, *(len(x or []) for x in lists)])
            raw, at = codec(path, pattern).decode(np.array([i for x in lists for i in x or []], np.int64), bounds)
            out = [raw[s:e].tobytes() for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def digest(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """A row a document: how many ids, a digest of the ids, and one of the bytes they decode to; one pass, nothing shuffled."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, "text", BATCH_BYTES):
            ids, bounds = c.encode(b.column("text"))
            spelt, at = c.spelt.of(ids)
            told = [sha256(spelt[s : max(e - 1, s)].tobytes()).hexdigest() for s, e in zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist())]
            raw, to = c.decode(ids, bounds)
            back = [sha256(raw[s:e].tobytes()).hexdigest() for s, e in zip(to[:-1].tolist(), to[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(told), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
