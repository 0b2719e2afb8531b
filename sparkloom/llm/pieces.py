"""Merge-type piece encoding with seeded merge-dropout, and its lossless decoding.

A word is a run of spaces with what follows up to the next space. Its characters are merged by an agenda: the pair
whose union is the vocabulary's best piece goes first, ties from the left. With probability `dropout` a candidate is
skipped, decided by a hash of the occurrence's key, place and piece, so a run can be repeated anywhere. The key is a hash
of seed, document and the word's place in it, so each occurrence of a word is cut on its own.
Characters outside the vocabulary, and a literal space mark, become byte pieces; decoding gives back the very bytes.

A worker remembers each word's pieces without a skip, and the candidates that its agenda takes then. An occurrence whose
key skips none of them is looked up; all others are merged with their own keys, those of a length side by side.

Null and empty texts have no piece. Rows that repeat a doc_id are cut alike if their texts are equal; a null doc_id counts as
0. Very long texts and words are encoded whole, in one worker. Further columns aren't read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8
from .shingles import mix

CACHE_WORDS = 600_000
SIDE_BY_SIDE = 48  # characters up to which words of a length are merged side by side in numpy
_NONE = 1 << 30
_MARK = "▁"
_ODD, _M32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF)


class PieceCoder:
    def __init__(self, model_file: str, seed: int = 0, dropout: float = 0.1):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        self.seed, self.limit = seed, int(dropout * (1 << 32))
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {names[i]: i for i in plain}
        self.rank = {names[i]: -sp.get_score(i) for i in plain}
        spelt = [b""] * size
        for i in plain:
            spelt[i] = names[i].replace(_MARK, " ").encode()
        for b, i in self.bytes.items():
            spelt[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.length = np.array([len(x) for x in spelt], np.int64)
        self.at = np.cumsum(self.length) - self.length
        # every pair of pieces that makes a piece, by left * size + right
        self.code = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.code[ord(p)] = i
        self.code[ord(" ")], self.code[ord(_MARK)] = self.code[ord(_MARK)], -1
        for b in range(128):  # byte pieces make no pair, so they stand beside the others as they are
            if self.code[b] < 0:
                self.code[b] = self.bytes[b]
        order = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (self.rank[names[i]], i)))}
        self.size = size
        made = sorted((self.ids[p[:k]] * size + self.ids[p[k:]], order[i], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair = np.array([m[0] for m in made], np.int64)
        self.pair_rank, self.pair_id = np.array([m[1] for m in made], np.int32), np.array([m[2] for m in made], np.int32)
        self.id_of_rank = np.zeros(size, np.int32)
        for i, r in order.items():
            self.id_of_rank[r] = i
        bits = 22
        self.slots, self.shift = np.full((1 << bits) + 64, -1, np.int32), np.uint64(64 - bits)
        self.reach = 0
        for k, h in enumerate((self.pair.astype(np.uint64) * _ODD >> self.shift).astype(np.int64).tolist()):
            r = 0
            while self.slots[h + r] >= 0:
                r += 1
            self.slots[h + r], self.reach = k, max(self.reach, r)
        self._reset()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that a and b make; _NONE if they make none."""
        key = a.astype(np.int64) * self.size + b
        h = (key.astype(np.uint64) * _ODD >> self.shift).astype(np.int64)
        out = np.full(len(key), _NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        for r in range(self.reach + 1):
            at = self.slots[h[todo] + r]
            todo, at = todo[at >= 0], at[at >= 0]
            hit = self.pair[at] == key[todo]
            out[todo[hit]] = self.pair_rank[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out

    def codes(self, words: list[str]) -> np.ndarray:
        """A row a word, all of one length: the piece of each character, -1 where the vocabulary has none."""
        n = len(words[0])
        return self.code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)]

    def same_length(self, ids: np.ndarray, key: np.ndarray | None, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """word() for many words of one length (rows of codes() without -1): the agendas go side by side, each takes its
        best candidate in every step. Returns all ids and their number a word. Without keys nothing is skipped; trace
        gets (words, candidates) of each step."""
        words, n = ids.shape
        ids, place = ids.copy(), np.tile(np.arange(n, dtype=np.int32), (words, 1))
        rank = np.full(ids.shape, _NONE, np.int32)
        if n > 1:
            rank[:, :-1] = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, n - 1)
        live = np.arange(words)
        a, s, r, k = ids, place, rank, key
        col = np.arange(n)
        while True:
            j = np.argmin(r, axis=1)
            best = r[np.arange(len(r)), j]
            more = best < _NONE
            if not more.all():
                ids[live] = a
                live, a, s, r, j, best = live[more], a[more], s[more], r[more], j[more], best[more]
                k = None if k is None else k[more]
            if not len(live):
                break
            row = np.arange(len(live))
            new = self.id_of_rank[best]
            candidate = ((s[row, j].astype(np.uint64) * np.uint64(0x9E3779B1)) ^ (new.astype(np.uint64) * np.uint64(0x85EBCA6B))) & _M32
            if trace is not None:
                trace.append((live, candidate))
            go = row
            if k is not None:
                skip = self._skipped(k ^ candidate)
                r[row[skip], j[skip]] = _NONE
                go = row[~skip]
            if len(go):
                at = j[go]
                take = np.minimum(col + (col > at[:, None]), n - 1)
                for m, fill in ((a, -1), (s, 0), (r, _NONE)):
                    moved = np.take_along_axis(m if len(go) == len(m) else m[go], take, axis=1)
                    moved[:, -1] = fill  # a merge frees one place at the end
                    m[go] = moved
                a[go, at] = new[go]
                r[go, at] = np.where(at + 1 < n, self._ranks(a[go, at], a[go, np.minimum(at + 1, n - 1)]), _NONE)
                left = at > 0
                r[go[left], at[left] - 1] = self._ranks(a[go[left], at[left] - 1], a[go[left], at[left]])
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _skipped(self, x: np.ndarray) -> np.ndarray:
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x7FEB352D)) & _M32
        x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x846CA68B)) & _M32
        return (x ^ (x >> np.uint64(16))) < np.uint64(self.limit)

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.after = np.zeros(1 << 16, np.uint32)
        self.after_start, self.after_count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.after_used = 0
        self.flat: np.ndarray = np.zeros(1 << 16, np.uint16)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def word(self, word: str, key: int | None = 0, trace: list | None = None) -> list[int]:
        """The ids of one word: the agenda. key, trace: as in same_length()."""
        rank, limit = self.rank, 0 if key is None else self.limit
        part = [_MARK if c == " " else c for c in word] if _MARK not in word else ["\0" if c == _MARK else _MARK if c == " " else c for c in word]
        n = len(part)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            both = part[i] + part[i + 1]
            if both in rank:
                agenda.append((rank[both], i, both))
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = after[i]
            if part[i] is None or j >= n or part[i] + part[j] != both:
                continue
            candidate = ((i * 0x9E3779B1) ^ (self.ids[both] * 0x85EBCA6B)) & 0xFFFFFFFF
            if trace is not None:
                trace.append(candidate)
            if limit:
                x = key ^ candidate
                x = ((x ^ (x >> 16)) * 0x7FEB352D) & 0xFFFFFFFF
                x = ((x ^ (x >> 15)) * 0x846CA68B) & 0xFFFFFFFF
                if (x ^ (x >> 16)) < limit:
                    continue
            part[i], part[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = both + part[k]
                if new in rank:
                    heapq.heappush(agenda, (rank[new], i, new))
            h = before[i]
            if h >= 0:
                new = part[h] + both
                if new in rank:
                    heapq.heappush(agenda, (rank[new], h, new))
        out, ids = [], self.ids
        for p in part:
            if p is not None:
                if p in ids:
                    out.append(ids[p])
                else:
                    out += [self.bytes[b] for b in (_MARK if p == "\0" and _MARK in word else p).encode()]
        return out

    def _keep(self, at: np.ndarray, ids: np.ndarray, lens: np.ndarray, after: np.ndarray, n_after: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.after_used + len(after) > len(self.after):
            self.after = np.concatenate([self.after, np.zeros_like(self.after)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.after[self.after_used : self.after_used + len(after)] = after
        self.start[at] = self.used + np.cumsum(lens) - lens
        self.count[at] = lens
        self.after_start[at] = self.after_used + np.cumsum(n_after) - n_after
        self.after_count[at] = n_after
        self.used += len(ids)
        self.after_used += len(after)

    def _learn(self, new: list[str]) -> None:
        """Remember words as they are without a skip."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(new):
            by.setdefault(len(w), []).append(k)
        n0 = len(self.index)
        while n0 + len(new) > len(self.start):
            self.start, self.count, self.after_start, self.after_count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.after_start, self.after_count))
        for n, at in by.items():
            code = self.codes([new[k] for k in at]) if n else np.full((len(at), 1), -1)
            at, known = np.array(at), (code >= 0).all(axis=1)
            if known.any():
                trace: list = []
                ids, lens = self.same_length(code[known], None, trace)
                steps, taken = np.zeros((len(lens), len(trace)), np.uint32), np.zeros(len(lens), np.int64)
                for t, (live, candidate) in enumerate(trace):
                    steps[live, t] = candidate
                    taken[live] = t + 1
                kept = np.arange(len(trace)) < taken[:, None]
                self._keep(n0 + at[known], ids, lens, steps[kept], taken)
            for k in at[~known].tolist():
                trace = []
                made = self.word(new[k], None, trace)
                self._keep(np.array([n0 + k]), np.array(made, np.int64), np.array([len(made)]), np.array(trace, np.uint32), np.array([len(trace)]))
        self.index.update(zip(new, range(n0, n0 + len(new))))

    def _with_skips(self, names: list[str], length: np.ndarray, code: np.ndarray, key: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the occurrences `which`, merged with their keys, and the number of each."""
        parts: list[np.ndarray] = []
        count, begin, total = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), 0
        by = np.argsort(length[code[which]], kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(length[code[which[by]]])) + 1) if len(by) else ():
            n = int(length[code[which[some[0]]]])
            alone = some
            if 0 < n <= SIDE_BY_SIDE:
                distinct, row = np.unique(code[which[some]], return_inverse=True)
                table = self.codes([names[k] for k in distinct.tolist()])
                known = (table >= 0).all(axis=1)[row]
                alone = some[~known]
                if known.any():
                    ids, lens = self.same_length(table[row[known]], key[which[some[known]]])
                    parts.append(ids)
                    count[some[known]], begin[some[known]] = lens, total + np.cumsum(lens) - lens
                    total += len(ids)
            for o in alone.tolist():
                made = self.word(names[code[which[o]]], int(key[which[o]]))
                parts.append(np.array(made, np.int64))
                count[o], begin[o] = len(made), total
                total += len(made)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        to = np.cumsum(count)
        return flat[np.repeat(begin - (to - count), count) + np.arange(len(flat))], count

    def encode(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n+1 boundaries between the texts; keys (one a text) choose what is skipped."""
        if len(self.index) > CACHE_WORDS:
            self._reset()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # a cut before each space that ends a run of other characters
        cut = pc.split_pattern(pc.replace_substring_regex(texts, r"([^ \x00]) ", "\\1\x00 "), "\x00")
        if pc.any(pc.match_substring(texts, "\x00")).as_py():
            cut = pa.array([_words(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        words, ends = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        coded = words.dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        n = np.diff(ends)
        place = np.arange(len(code)) - np.repeat(ends[:-1], n)
        key = mix(np.repeat(mix(keys.astype(np.uint64) + np.uint64(self.seed)), n) + place.astype(np.uint64)) & _M32
        length = np.array([len(w) for w in names], np.int64)
        # long words hardly repeat, and nearly all have a skip
        if new := [w for w in names if w not in self.index and len(w) <= SIDE_BY_SIDE]:
            self._learn(new)
        at = np.array([self.index.get(w, -1) for w in names], np.int64)[code] if names else np.zeros(0, np.int64)
        own = at < 0
        if self.limit:
            known = np.flatnonzero(~own)
            steps = self.after_count[at[known]]
            whose = np.repeat(known, steps)
            step = np.arange(len(whose)) - np.repeat(np.cumsum(steps) - steps, steps) + np.repeat(self.after_start[at[known]], steps)
            own[whose[self._skipped(key[whose] ^ self.after[step].astype(np.uint64))]] = True
        fresh, lens = np.flatnonzero(own), np.zeros(len(at), np.int64)
        made, lens[fresh] = self._with_skips(names, length, code, key, fresh)
        lens[~own] = self.count[at[~own]]
        to = np.concatenate([[0], np.cumsum(lens)])
        out = np.empty(to[-1], np.int64)
        for which, flat, start in ((np.flatnonzero(~own), self.flat, self.start[at[~own]]), (fresh, made, np.cumsum(lens[fresh]) - lens[fresh])):
            size = lens[which]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(to[which], size) + inner] = flat[np.repeat(start, size) + inner]
        return out, to[ends]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, and their n+1 boundaries."""
        lens = self.length[ids]
        to = np.concatenate([[0], np.cumsum(lens)])
        return self.spelt[np.repeat(self.at[ids] - to[:-1], lens) + np.arange(to[-1])], to[bounds]


def _words(text: str) -> list[str]:
    out, start = [], 0
    for k in range(1, len(text)):
        if text[k] == " " and text[k - 1] != " ":
            out.append(text[start:k])
            start = k
    return [*out, text[start:]]


_coders: dict[tuple, PieceCoder] = {}
_CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def _encoder(*setting):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.setdefault(setting, PieceCoder(*setting)) if setting not in _coders else _coders[setting]
        for b in slices(batches, "text", 1 << 22):
            ids, to = coder.encode(b.column("text"), b.column("doc_id").fill_null(0).to_numpy())
            raw, off = coder.decode(ids, to)
            data, text = ids.astype("<u2").tobytes(), raw.tobytes()
            cols = [b.column("doc_id"), pa.array([data[2 * s : 2 * e] for s, e in zip(to[:-1].tolist(), to[1:].tolist())], pa.binary()), pa.array([text[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=_CODED)

    return encode


def encode(docs: DataFrame, model_file: str, seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """doc_id, ids (little-endian 16-bit), decoded (the bytes that decoding them gives)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoder(model_file, seed, dropout), "doc_id long, ids binary, decoded binary")


def encode_digest(docs: DataFrame, model_file: str, seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256."""
    coded = encode(docs, model_file, seed, dropout)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 2).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))
