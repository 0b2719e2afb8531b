"""Suffix-array dedup of byte strings that repeat within and across documents.

A byte goes if a `WIN`-byte string that covers it also starts earlier (smaller doc_id, or the same document and an
earlier start). Strings are judged on the input; they never cross documents.

1. Anchors (see anchors.py) cut the work: a repeated string has a repeated anchor. Those that occur once end here.
2. Where all bytes that an anchor's strings can cover are equal, later copies go as a whole.
3. The others are looked at in four classes of offsets. A class's strings share a core of some 84 bytes, so regions
   meet only where the core repeats; equal regions collapse again.
4. What is left goes to shards by its core. A shard builds suffix arrays of bounded pieces by Larsson-Sadakane
   refinement, finds strings with a common prefix of `WIN` bytes by Kasai's method, and merges the pieces' sorted
   strings by binary search.
5. A core with over `HOT` different regions is dealt string by string instead: every string is grouped by its hash, a
   pre-aggregated minimum finds its first start. No group has to fit in a task.

Null and empty texts have no byte and lose none; texts under `WIN` bytes lose none. Rows that repeat an id are taken to be
one document, read more than once: neither starts earlier than the other, and all lose the same bytes. A very long text is
cut into anchors and regions in one worker; further columns aren't read. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SPAN, WIN, Hashes, anchors
from .common import hot_above, materialise, release, replace_texts, salted_join, slices, utf8
from .neardup import groups

CLASSES = ((0, 17), (18, 35), (36, 52), (53, SPAN))
HOT = 4096  # different regions of one core that a shard takes
SHARD = 4_000  # regions of a shard
PIECE = 1 << 20  # bytes of a suffix array


# -- suffix arrays ---------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int = WIN) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes at least. Larsson-Sadakane: only groups not yet told apart are
    sorted again, by the rank of what follows, twice as far each time."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | wide[j : j + n]
    sa = np.argsort(key, kind="stable")
    # shorter than 8 bytes sorts before what has zeros there: by what is left of it
    tail = np.minimum(n - np.arange(n), 8)
    sa = sa[np.lexsort((tail[sa], key[sa]))] if n and (key[sa][1:] == key[sa][:-1]).any() else sa
    new = np.ones(n, bool)
    new[1:] = (key[sa][1:] != key[sa][:-1]) | (tail[sa][1:] != tail[sa][:-1])
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < depth:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        pos = sa[slots]
        group, follow = rank[pos], rank[np.minimum(pos + h, n)]
        order = np.argsort(group * (n + 2) + follow + 1, kind="stable")
        pos, group, follow = pos[order], group[order], follow[order]
        sa[slots] = pos
        fresh = np.ones(len(pos), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[slots] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cap: int = WIN) -> np.ndarray:
    """For each place in sa, the common prefix with the suffix before it, `cap` at most. Kasai's method: going on by
    one position loses one byte of the prefix at most, if the two suffixes that go on keep their order. sa may leave open
    how suffixes equal in `cap` bytes stand; where they change places it is counted anew. The regions at `starts` go side by side."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.full(n + 1, -1, np.int64)
    place[sa] = np.arange(n)
    out = np.zeros(n, np.int64)
    lane, last = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    for t in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > t)
        pos, run = starts[live] + t, np.maximum(lane[live] - 1, 0)
        other = before[pos]
        run[(other < 0) | (place[last[live] + 1] > place[pos])] = 0
        last[live] = other
        todo = np.flatnonzero((other >= 0) & (run < cap))
        while len(todo):
            a, b = pos[todo] + run[todo], other[todo] + run[todo]
            todo, a, b = (x[(a < n) & (b < n)] for x in (todo, a, b))
            todo = todo[text[a] == text[b]]
            run[todo] += 1
            todo = todo[run[todo] < cap]
        lane[live] = run
        out[pos] = run
    return out[sa]


class Piece:
    """One suffix array: its distinct strings in order, with the first start of each."""

    def __init__(self, docs: np.ndarray, begins: np.ndarray, regions: list[bytes]):
        text = np.frombuffer(b"".join(regions), np.uint8)
        lengths = np.array([len(r) for r in regions], np.int64)
        starts = np.cumsum(lengths) - lengths
        sa = suffix_array(text)
        lcp = common_prefixes(text, sa, starts, lengths)
        run = np.cumsum(lcp < WIN) - 1
        region = np.repeat(np.arange(len(regions)), lengths)
        inside = np.arange(len(text)) - starts[region]
        whole = (lengths[region] - inside >= WIN)[sa]
        at, run = sa[whole], run[whole]
        doc, p = docs[region[at]], begins[region[at]] + inside[at]
        order = np.lexsort((p, doc, run))
        at, run, doc, p = at[order], run[order], doc[order], p[order]
        new = np.ones(len(run), bool)
        new[1:] = run[1:] != run[:-1]
        first = np.flatnonzero(new)
        owner = first[np.cumsum(new) - 1] if len(first) else first
        later = (doc != doc[owner]) | (p != p[owner])  # the same start may lie in two regions
        self.gone = [(doc[later], p[later])]
        strings = np.lib.stride_tricks.sliding_window_view(text, WIN)[at[first]] if len(first) else np.zeros((0, WIN), np.uint8)
        self.strings = np.ascontiguousarray(strings).view(f"V{WIN}").ravel()
        self.doc, self.start = doc[first], p[first]

    def merge(self, other: "Piece") -> None:
        """Strings that both have: the later first start goes too. Binary search in the other's order."""
        if not len(self.strings) or not len(other.strings):
            return
        k = np.minimum(np.searchsorted(other.strings, self.strings), len(other.strings) - 1)
        same = np.flatnonzero(other.strings[k] == self.strings)
        k = k[same]
        mine = (self.doc[same] > other.doc[k]) | ((self.doc[same] == other.doc[k]) & (self.start[same] > other.start[k]))
        theirs = ~mine & ((self.doc[same] != other.doc[k]) | (self.start[same] != other.start[k]))
        self.gone.append((self.doc[same[mine]], self.start[same[mine]]))
        other.gone.append((other.doc[k[theirs]], other.start[k[theirs]]))


def spans(doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes (doc, start, end) that strings starting at p cover."""
    order = np.lexsort((p, doc))
    doc, p = doc[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (p[1:] > p[:-1] + WIN)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1 if len(p) else first
    return doc[first], p[first], p[last] + WIN


_SPAN = pa.schema([("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
_SPAN_DDL = "doc_id long, s long, e long"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(b: pa.RecordBatch) -> list:
        return list(zip(b.column("doc_id").to_pylist(), b.column("s").to_pylist(), b.column("bytes").to_pylist()))

    for _, held in groups(batches, "shard", rows):
        pieces, at = [], 0
        while at < len(held):
            to, size = at, 0
            while to < len(held) and (to == at or size + len(held[to][2]) <= PIECE):
                size += len(held[to][2])
                to += 1
            some = held[at:to]
            new = Piece(np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int64), [r[2] for r in some])
            for other in pieces:
                new.merge(other)
            pieces.append(new)
            at = to
        gone = [g for p in pieces for g in p.gone]
        out = spans(np.concatenate([g[0] for g in gone]), np.concatenate([g[1] for g in gone]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=_SPAN)


# -- anchors and regions ---------------------------------------------------------------------------------------------

_ANCHOR = pa.schema([("a", pa.int64()), ("r", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64())])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 20):
        raw, off = utf8(b.column("text"))
        at, text, gram, region = anchors(raw, off)
        cols = [gram, region, b.column("doc_id").to_numpy()[text], at - off[text]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ANCHOR)


_REGION = pa.schema([("core", pa.int64()), ("r", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int64()), ("bytes", pa.binary())])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of every anchor that stands in `at`."""
    for b in slices(batches, "text", 1 << 20):
        raw, off = utf8(b.column("text"))
        lists = b.column("at")
        where = lists.flatten().to_numpy()
        if not len(where):
            continue
        doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        ids, data = b.column("doc_id").to_numpy(), raw.tobytes()
        h = Hashes(raw)
        i = where + off[doc]
        for c, (lo, hi) in enumerate(CLASSES):
            s, e = np.maximum(i - hi, off[doc]), np.minimum(i - lo + WIN, off[doc + 1])
            ok = np.flatnonzero(e - s >= WIN)
            if not len(ok):
                continue
            s, e, j = s[ok], e[ok], i[ok]
            core = h.of(j - lo, j - hi + WIN) + np.uint64(c)
            region = h.of(s, e) + (j - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            cols = [pa.array(core.view(np.int64)), pa.array(region.view(np.int64)), pa.array(ids[doc[ok]]), pa.array(s - off[doc[ok]]), pa.array([data[x:y] for x, y in zip(s.tolist(), e.tolist())], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=_REGION)


_STRING = pa.schema([("core", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int64())])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of hot regions by its hash."""
    for b in slices(batches, "bytes", 1 << 20):
        raw, off = utf8(b.column("bytes"))
        n = np.diff(off) - WIN + 1
        row = np.repeat(np.arange(b.num_rows), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = off[row] + k
        cols = [b.column("core").to_numpy()[row], Hashes(raw).of(at, at + WIN).view(np.int64), b.column("doc_id").to_numpy()[row], b.column("s").to_numpy()[row] + k]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_STRING)


def _start_key(docs: DataFrame):
    """Orders starts (doc_id, position): one long where ids leave room for it, which aggregates faster than a struct."""
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if ends["a"] is not None and 0 <= ends["a"] and ends["b"] < 1 << 32:
        return lambda at: F.shiftleft("doc_id", 31).bitwiseOR(F.col(at))
    return lambda at: F.struct("doc_id", at)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, s, e): stretches of bytes that repeat what starts earlier; they may overlap."""
    ddl = "a long, r long, doc_id long, pos long"
    found = docs.mapInArrow(_anchors, ddl)
    counts = found.groupBy("a").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).where("n > 1")
    again = materialise(counts.select("a", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "again")
    above = hot_above(again.agg(F.sum("n").alias("t")).first()["t"] or 0)
    repeated = salted_join(found, again, ["a"], "n", again.where(F.col("n") > above), above)
    repeated = materialise(repeated.select("a", "r", "doc_id", "pos", "mixed", (F.col("n") > above).alias("hot")), "anchors")
    release(again)

    key = _start_key(docs)
    firsts = repeated.groupBy("a", "r").agg(F.min(key("pos")).alias("f"), F.count("*").alias("n"))
    # a hot region has a hot anchor, so these few are counted among the rows of such anchors
    hot = repeated.where("hot").groupBy("a", "r").agg(F.count("*").alias("n")).where(F.col("n") > above)
    told = salted_join(repeated.drop("hot"), firsts, ["a", "r"], "n", hot, above).withColumn("late", key("pos") != F.col("f"))
    told = materialise(told.where("late or mixed").select("doc_id", "pos", "late"), "told")
    release(repeated)
    copies = told.where("late").select("doc_id", F.greatest(F.col("pos") - SPAN, F.lit(0)).alias("s"), (F.col("pos") + WIN).alias("e"))

    open_ = told.where("not late").groupBy("doc_id").agg(F.collect_list("pos").alias("at"))
    regions = materialise(docs.join(open_, "doc_id").mapInArrow(_regions, "core long, r long, doc_id long, s long, bytes binary"), "regions")
    seen = regions.select("core", "r", "doc_id", "s").groupBy("core", "r").agg(F.min(key("s")).alias("f"), F.count("*").alias("copies"))
    cores = seen.groupBy("core").agg(F.count("*").alias("n"))
    told = seen.join(cores, "core").where("n > 1 OR copies > 1").select("core", "r", "f", "n")
    # equal regions of a class: later ones go as a whole; the bytes are shuffled once
    same = regions.join(told, ["core", "r"]).withColumn("late", key("s") != F.col("f"))
    left = materialise(same.where("late or n > 1").select("core", "doc_id", "s", "n", "late", F.length("bytes").alias("len"), F.when(~F.col("late"), F.col("bytes")).alias("bytes")), "cores")
    release(regions)
    later = left.where("late").select("doc_id", "s", (F.col("s") + F.col("len")).alias("e"))

    plain = left.where((~F.col("late")) & (F.col("n") <= HOT))
    shards = F.lit(max(1, plain.count() // SHARD))
    merged = plain.select(F.pmod(F.xxhash64("core"), shards).alias("shard"), "doc_id", "s", "bytes").repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, _SPAN_DDL)

    strings = left.where((~F.col("late")) & (F.col("n") > HOT)).mapInArrow(_strings, "core long, h long, doc_id long, s long")
    # strings meet inside a core alone: two hashes tell them apart
    start = strings.groupBy("core", "h").agg(F.min(key("s")).alias("f"), F.count("*").alias("n")).where("n > 1")
    hot = strings.join(start, ["core", "h"]).where(key("s") != F.col("f")).select("doc_id", "s", (F.col("s") + WIN).alias("e"))
    return copies.unionByName(later).unionByName(merged).unionByName(hot)


def cut(data: bytes, s: np.ndarray, e: np.ndarray) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the number of maximal removed runs."""
    e = np.minimum(e, len(data))
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    a, b = s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist()
    kept = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)]))
    return kept, len(data) - len(kept), len(a)


def _lists(b: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    raw, off = utf8(b.column("text"))
    for k, spans_ in enumerate(b.column("_sl_spans")):
        data = raw[off[k] : off[k + 1]].tobytes()
        v = spans_.values if spans_.is_valid else None
        none = np.zeros(0, np.int64)
        yield data, v.field("s").to_numpy() if v is not None else none, v.field("e").to_numpy() if v is not None else none


def with_spans(docs: DataFrame) -> DataFrame:
    """docs and `_sl_spans`, the list of repeated stretches (null: none)."""
    found = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return docs.join(found.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("_sl_spans")), "doc_id", "left")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 22):
        rows = []
        for data, s, e in _lists(b):
            kept, gone, n = cut(data, s, e) if len(s) else (data, 0, 0)
            rows.append((len(data), gone, n, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t.type) for v, t in zip(zip(*rows), list(_DIGEST)[1:]))], schema=_DIGEST)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(docs).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(data: bytes, s: np.ndarray, e: np.ndarray) -> str:
    """What is left, piece by piece: a character of which a byte is gone goes, and its rest joins with no other."""
    if not len(s):
        return data.decode()
    gone = np.zeros(len(data) + 1, np.int64)
    np.add.at(gone, s, 1)
    np.add.at(gone, np.minimum(e, len(data)), -1)
    left = np.cumsum(gone)[:-1] == 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], left, [False]]).astype(np.int8)))
    return "".join(data[x:y].decode("utf-8", "ignore") for x, y in zip(turn[::2].tolist(), turn[1::2].tolist()))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 22):
        texts, keep = [], []
        for old, (data, s, e) in zip(b.column("text"), _lists(b)):
            kept = cut(data, s, e)[0] if len(s) else data
            texts.append(whole_characters(data, s, e) if old.is_valid else None)
            keep.append(not len(s) or bool(kept.strip()))
        yield replace_texts(b, texts, keep, "_sl_spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes taken out of text (a character cut apart goes whole); rows that lose all they had go."""
    return with_spans(docs).mapInArrow(_cleaned, docs.schema)
