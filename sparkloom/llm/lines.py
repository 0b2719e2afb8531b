"""Line dedup by a log-template tree.

A line's tokens are its words, lower-cased, with those that hold a digit made variable. The tree has a fixed depth:
token count, then the first `DEPTH` tokens. Inside a leaf, lines in order of frequency join the template they agree with
on `ALIKE` of the tokens or more (places that differ become variable) or found a new one. A leaf with over `WIDE`
different lines is clustered in parts of some `WIDE` lines; then all its parts' templates, in order of frequency, join one
another by the same rule. Templates found in `MIN_DOCS` documents or more recur: their lines are dropped from every
document but the first (smallest doc_id).

Lines are counted before anything is compared, so a line that a third of all documents hold is one row. Only leaves
with `MIN_DOCS` lines or more are opened. Null and empty texts have no line; blank lines stay; ties among templates go to the
older one. A document may lose all lines. Rows that repeat an id are one document with the lines of all, and have the same
lines dropped each. A very long text is cut into lines in one worker; further columns aren't read. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_above, materialise, replace_texts, salted_join, slices, utf8
from .neardup import groups
from .shingles import mix, word_hashes

DEPTH, WIDE, ALIKE, MIN_DOCS = 3, 2000, 0.7, 5
_VARIABLE = np.uint64(0x5851F42D4C957F2D)
_ODD = np.uint64(0x9FB21C651E98DF25)


def line_table(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all lines of all texts: text, start and end byte, first and last+1 token, hash, leaf; and the tokens."""
    cut = np.flatnonzero(raw == 10)
    full = np.flatnonzero(np.diff(off))
    # a newline at the end of a text starts no line of its own: what follows is the next text's first line or nothing
    start = np.unique(np.concatenate([off[:-1][full], cut + 1]))
    start = start[start < off[-1]]
    text = np.searchsorted(off, start, "right") - 1
    end = np.append(start[1:], off[-1])
    words, to = word_hashes(raw, np.append(start, len(raw)))
    digit = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    if len(words):
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        head = ~space
        head[1:] &= space[:-1]
        inner = start[(start > 0) & (start < len(raw))]
        head[inner] = ~space[inner]
        ws = np.flatnonzero(head)
        we = np.append(ws[1:], len(raw))
        words = np.where(digit[we] > digit[ws], _VARIABLE, words)
    first, last = to[:-1], to[1:]
    n = last - first
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(n.max(initial=1)), _ODD)]))
    place = np.arange(len(words)) - np.repeat(first, n)
    run = np.concatenate([[np.uint64(0)], np.cumsum(words * power[place])])
    line = mix(run[last] - run[first] + n.astype(np.uint64))
    leaf = n.astype(np.uint64)
    for k in range(DEPTH):
        leaf = mix(leaf * _ODD + np.where(n > k, words[np.minimum(first + k, max(0, len(words) - 1))] if len(words) else np.uint64(0), np.uint64(1)))
    return text, start, end, first, last, line, leaf, words


_LINE = pa.schema([("leaf", pa.int64()), ("line", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.binary())])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 21):
        raw, off = utf8(b.column("text"))
        text, _, _, first, last, line, leaf, words = line_table(raw, off)
        short = (words >> np.uint64(33)).astype(np.uint32).tobytes()  # 31 bits: -1 marks a variable place
        full = np.flatnonzero(last > first)
        _, once = np.unique(np.stack([text[full], line[full].view(np.int64)]), axis=1, return_index=True)
        at = full[once]
        cols = [leaf[at].view(np.int64), line[at].view(np.int64), b.column("doc_id").to_numpy()[text[at]]]
        tokens = pa.array([short[4 * s : 4 * e] for s, e in zip(first[at].tolist(), last[at].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), tokens], schema=_LINE)


_MEMBER = pa.schema([("line", pa.int64()), ("template", pa.int64()), ("leaf", pa.int64()), ("n", pa.int64()), ("pattern", pa.binary()), ("each", pa.int64())])
_INTO = pa.schema([("template", pa.int64()), ("into", pa.int64())])
#: Founders from which on the candidates are looked up by segments; the result is the same.
_INDEXED = 256


def clustered(tokens: list[np.ndarray]) -> tuple[list[int], dict[int, np.ndarray]]:
    """The template of each line, as the index of the line that founded it, and each founder's pattern (-1: variable).
    Lines are as long as one another; they may be patterns, whose variable places agree with nothing.

    Who agrees on `need` of n places agrees on one of n - need + 1 segments, so equal segments find every candidate."""
    n = len(tokens[0])
    need = math.ceil(ALIKE * n)
    bounds = np.linspace(min(DEPTH, n), n, n - need + 2).astype(int).tolist()
    spans = list(zip(bounds, bounds[1:]))
    narrow = any(x == y for x, y in spans)
    made = np.zeros((16, n), np.int32)
    founder: list[int] = []
    index: dict[tuple[int, bytes], list[int]] = {}
    out = []

    def segments(t: np.ndarray) -> list[tuple[int, bytes]]:
        return [(x, t[x:y].tobytes()) for x, y in spans if (t[x:y] >= 0).all()]

    for k, t in enumerate(tokens):
        t = t.astype(np.int32)
        indexed = not narrow and len(founder) >= _INDEXED
        if founder:
            at = None
            if indexed:
                hits = [index[s] for s in segments(t) if s in index]
                if sum(map(len, hits)) < len(founder) // 2:
                    at = np.array(sorted({f for h in hits for f in h}), np.int64)
            fixed = t >= 0
            alike = ((made[: len(founder)] if at is None else made[at]) == t)[:, fixed].sum(axis=1)
            if len(alike) and alike.max() >= need:
                best = int(np.argmax(alike)) if at is None else int(at[np.argmax(alike)])
                made[best][made[best] != t] = -1
                out.append(founder[best])
                continue
        if len(founder) == len(made):
            made = np.concatenate([made, np.zeros_like(made)])
        made[len(founder)] = t
        founder.append(k)
        out.append(k)
        if not narrow:
            for f in range(len(founder) - 1, len(founder)) if indexed else range(_INDEXED) if len(founder) == _INDEXED else ():
                for s in segments(tokens[founder[f]].astype(np.int32)):
                    index.setdefault(s, []).append(f)
    return out, {k: made[f] for f, k in enumerate(founder)}


def cluster(tokens: list[np.ndarray]) -> list[int]:
    return clustered(tokens)[0]


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The template of each line; in parts of a leaf also the leaf, and beside founders the template's frequency and pattern."""

    def rows(b: pa.RecordBatch) -> list:
        return list(zip(*(b.column(c).to_pylist() for c in ("line", "n", "tokens", "leaf", "wide"))))

    for _, held in groups(batches, "part", rows):
        held.sort(key=lambda r: (-r[1], r[0]))
        of, patterns = clustered([np.frombuffer(r[2], np.uint32) for r in held])
        leaf, n, pattern = ([None] * len(held) for _ in range(3))
        if held[0][4]:
            leaf = [r[3] for r in held]
            every = np.bincount(of, weights=[r[1] for r in held])
            for k, p in patterns.items():
                n[k], pattern[k] = int(every[k]), p.tobytes()
        cols = [[r[0] for r in held], [held[k][0] for k in of], leaf, n, pattern, [r[1] for r in held]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(cols, _MEMBER)], schema=_MEMBER)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each template of a leaf's parts becomes a part of (itself, if nothing)."""

    def rows(b: pa.RecordBatch) -> list:
        return list(zip(*(b.column(c).to_pylist() for c in ("template", "n", "pattern"))))

    for _, held in groups(batches, "leaf", rows):
        held.sort(key=lambda r: (-r[1], r[0]))
        of = cluster([np.frombuffer(r[2], np.int32) for r in held])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([held[k][0] for k in of], pa.int64())], schema=_INTO)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, line): lines of recurring templates that the document loses, by hash."""
    found = docs.mapInArrow(_lines, "leaf long, line long, doc_id long, tokens binary")
    # one pass makes both what is counted and what is looked up again
    found = materialise(found, "lines")
    distinct = found.groupBy("leaf", "line").agg(F.count("*").alias("n"))
    leaves = distinct.groupBy("leaf").agg(F.sum("n").alias("all"), F.count("*").alias("lines")).where(F.col("all") >= min_docs)
    open_ = materialise(distinct.join(leaves, "leaf"), "leaves")
    single = open_.where("lines = 1").select("line", F.col("line").alias("template"), "n")
    several = open_.where("lines > 1").select("leaf", "line", "n", "lines")
    above = hot_above(open_.agg(F.sum("n").alias("t")).first()["t"] or 0)
    hot = open_.where(F.col("n") > above).select("line")
    # merge hints: the same plan at every size. A hot line's rows are aggregated where they lie, the others where they meet
    cold = found.join(F.broadcast(hot), "line", "left_anti").join(several.select("line").distinct().hint("merge"), "line", "left_semi")
    warm = found.join(F.broadcast(several.where(F.col("n") > above).select("line")), "line", "left_semi")
    tokens = cold.groupBy("line").agg(F.max("tokens").alias("tokens")).unionByName(warm.groupBy("line").agg(F.max("tokens").alias("tokens")))
    wide = F.col("lines") > WIDE
    part = F.when(wide, F.xxhash64("leaf", F.pmod(F.xxhash64("line"), F.ceil(F.col("lines") / WIDE)))).otherwise(F.col("leaf"))
    parts = several.join(tokens, "line").select(part.alias("part"), "leaf", wide.alias("wide"), "line", "n", "tokens").repartition("part").sortWithinPartitions("part")
    made = materialise(parts.mapInArrow(_templates, "line long, template long, leaf long, n long, pattern binary, each long"), "parts")
    tops = made.where("pattern IS NOT NULL").select("leaf", "template", "n", "pattern").repartition("leaf").sortWithinPartitions("leaf")
    into = tops.mapInArrow(_merged, "template long, into long")
    whole = made.where("leaf IS NULL").select("line", "template", F.col("each").alias("n"))
    joined = made.where("leaf IS NOT NULL").select("line", "template", "each").join(into.hint("merge"), "template").select("line", F.col("into").alias("template"), F.col("each").alias("n"))
    member = materialise(single.unionByName(whole).unionByName(joined), "templates")
    held = materialise(salted_join(found.select("line", "doc_id"), member, ["line"], "n", hot, above).drop("n"), "held")
    each = held.groupBy("template", "doc_id").agg(F.count("*").alias("c"))
    recurs = materialise(each.groupBy("template").agg(F.count("*").alias("docs"), F.sum("c").alias("n"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs), "recurring")
    # a template can be hot though none of its lines is
    lost = salted_join(held, recurs, ["template"], "n", recurs.where(F.col("n") > above), above)
    return lost.where(F.col("doc_id") != F.col("first")).select("doc_id", "line")


def _drop(b: pa.RecordBatch) -> Iterator[tuple[bytes, int, int]]:
    """The text left of each row, its number of lines and of those dropped."""
    raw, off = utf8(b.column("text"))
    text, start, end, first, last, line, _, _ = line_table(raw, off)
    data, bounds = raw.tobytes(), np.searchsorted(text, np.arange(b.num_rows + 1))
    lines = line.view(np.int64)
    for k, gone in enumerate(b.column("_sl_gone")):
        s, e = bounds[k], bounds[k + 1]
        whole = data[off[k] : off[k + 1]]
        if not gone.is_valid or not len(gone):
            yield whole, int(e - s), 0
            continue
        lost = np.isin(lines[s:e], gone.values.to_numpy()) & (last[s:e] > first[s:e])
        yield b"".join(data[x:y] for x, y, z in zip(start[s:e].tolist(), end[s:e].tolist(), lost) if not z), int(e - s), int(lost.sum())


def with_gone(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs and `_sl_gone`, the hashes of the lines each loses (null: none)."""
    lost = recurring_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), min_docs)
    gone = lost.groupBy("doc_id").agg(F.collect_set("line").alias("_sl_gone"))
    return docs.join(gone.hint("merge"), "doc_id", "left")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 21):
        rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for kept, n, gone in _drop(b)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t.type) for v, t in zip(zip(*rows), list(_DIGEST)[1:]))], schema=_DIGEST)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_gone(docs).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 21):
        texts, keep = [], []
        for old, (kept, _, gone) in zip(b.column("text"), _drop(b)):
            texts.append(kept.decode() if old.is_valid else None)
            keep.append(not gone or bool(kept.strip()))
        yield replace_texts(b, texts, keep, "_sl_gone")


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines of recurring templates taken out of text; rows that lose all they had go."""
    return with_gone(docs, min_docs).mapInArrow(_cleaned, docs.schema)
