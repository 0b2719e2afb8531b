"""Token ids in a compressed binary file: adaptive context mixing and a range coder, in independent blocks.

A file is a table of chunks. A chunk holds the ids of whole documents, their doc_ids and lengths, a header and blocks.
The header lists the chunk's different ids with their frequencies: the state that every block starts from. Each block of
`BLOCK` ids is reset to it, has its own coder and a crc32, so with the header it can be read alone and damage stays inside.

The model predicts an id from three orders. Order 2 and order 1 look up the id that last followed the two ids or the one
id before (hashed slots, with the hits in a row as confidence); order 0 is the distribution of the header. Weights for
each order and confidence, which follow hits and misses, mix the three:
P = w2 [id = guess2] + (1-w2) w1 [id = guess1] + (1-w2)(1-w1) P0. The range coder codes whole ids by P.

Blocks don't depend on each other, so numpy codes many at once, one id of each in every step. The reader steps model and coder.
The writer has all ids, so it sorts those of a block by slot, which tells guesses, hits and confidences at once, and steps the
weights and the coder alone.

Null texts are empty and have the end id alone. Rows that repeat a doc_id are documents each, in order of text. A very long
text is encoded in one worker, its ids span blocks. Further columns of docs aren't read; an empty table gives no file row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .tokens import encoder, with_end

BLOCK = 2048  # ids of a block
LANES = 2048  # blocks coded side by side, half as many more at most
CHUNK = 4_000_000  # ids after which a chunk is closed
SLOTS = 1024  # a power of two
BITS = 24  # of the coder's total
TOTAL = 1 << BITS
ROOM = TOTAL - (TOTAL >> 3)  # what orders 1 and 2 have at most
CONF = 8  # confidences; the last one says that a slot is empty
FREQ = 18  # bits of the header's total
_LOW, _W, _BITS, _ONE, _FIVE = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(BITS), np.uint64(1), np.uint64(5)
GROUP = 16  # steps of the writer whose shares are computed together


class _Header:
    """Order 0: the different ids, and the borders of their frequencies in a total of 2**bits."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids, freq
        self.bits = int(freq.sum()).bit_length() - 1
        self.edge = np.concatenate([[0], np.cumsum(freq)])

    def share(self, ids: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' shares of what lies behind base."""
        rest = TOTAL - base
        start, width = self.edge.take(ids), self.edge[1:].take(ids)
        for x in (start, width):
            x *= rest
            x >>= self.bits
        width -= start
        start += base
        return start, width

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple["_Header", np.ndarray]:
        """The header, and the ids as places in it."""
        if (top := int(ids.max())) < 1 << 24:  # the same by a table, some ids at a time
            every, places = np.zeros(top + 1, np.int64), np.empty(len(ids), np.int32)
            step = max(1 << 16, top)
            for s in range(0, len(ids), step):
                few = np.bincount(ids[s : s + step])
                every[: len(few)] += few
            names = np.flatnonzero(every)
            count, place = every[names], np.zeros(len(every), np.int32)
            place[names] = np.arange(len(names))
            for s in range(0, len(ids), step):
                places[s : s + step] = place.take(ids[s : s + step])
        else:
            names, places, count = np.unique(ids, return_inverse=True, return_counts=True)
        total = 1 << max(FREQ, len(names).bit_length() + 1)
        freq = 1 + count * (total - len(names)) // len(ids)
        freq[np.argmax(freq)] += total - freq.sum()
        return cls(names.astype(np.int64), freq), places

    def pack(self) -> bytes:
        data = zlib.compress(np.diff(self.ids, prepend=0).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes(), 9)
        return struct.pack("<III", len(self.ids), len(data), zlib.crc32(data)) + data

    @classmethod
    def unpack(cls, data: bytes) -> tuple["_Header", int]:
        """The header and where the blocks begin."""
        n, size, crc = struct.unpack_from("<III", data, 0)
        if zlib.crc32(data[12 : 12 + size]) != crc:
            raise ValueError("the header's checksum differs")
        both = np.frombuffer(zlib.decompress(data[12 : 12 + size]), "<u4").astype(np.int64)
        return cls(np.cumsum(both[:n]), both[n:]), 12 + size


def _shares(w2: np.ndarray, w1: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of the total the guesses of order 2 and of order 1 have; the same guess has one share."""
    f2 = w2 * ROOM >> BITS
    return f2, (w1 * (ROOM - f2) >> BITS) * differ


def _taken(start: np.ndarray, width: np.ndarray, by: np.ndarray, begin: np.ndarray | int, share: np.ndarray) -> None:
    """Where an id is coded by a guess, its interval is the guess's."""
    np.copyto(start, begin, where=by)
    np.copyto(width, share, where=by)


#: Where weights go after a miss and after a hit (8 more), by confidence: an empty slot's weight stays nothing.
_AIM = np.repeat([4096, TOTAL - 4096], CONF)
_AIM[CONF - 1 :: CONF] = 0
#: The model's own order, hits before misses: the same, and the confidences that follow.
_AIM_OF, _NEXT = np.roll(_AIM, CONF), np.append(np.minimum(np.arange(1, CONF + 1), CONF - 2), np.zeros(CONF, np.int64))
_SHIFT = np.array([[9], [7]], np.uint32)  # of the hashes of order 2 and order 1
_MASK, _LAST, _BEFORE = np.uint32(SLOTS - 1), np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


class _Weights:
    """The weight of each confidence of order 2 and order 1, for n blocks; none where a slot is empty."""

    def __init__(self, n: int):
        self.flat = np.full(2 * n * CONF, TOTAL >> 2, np.int64)
        self.flat[CONF - 1 :: CONF] = 0
        self.row = np.arange(2 * n).reshape(2, n) * CONF

    def learn(self, which: np.ndarray, now: np.ndarray, aim: np.ndarray) -> None:
        """aim is overwritten."""
        aim -= now
        aim >>= 4
        aim += now
        self.flat[which] = aim


class _Model:
    """The state of n blocks: what their slots guess, order 2 before order 1. A slot holds (id + 1) * CONF + confidence."""

    def __init__(self, n: int, kind: type = np.int32):
        self.slots = np.full(2 * n * SLOTS, CONF - 1, kind)
        self.next = _NEXT.astype(kind)
        self.lane, self.wide = np.arange(n) + np.array([[0], [n * SLOTS]]), np.uint32(n)  # a slot of all blocks lies side by side
        self.weights = _Weights(n)
        self.given = np.zeros((3, n), np.int64)  # nothing, then what the guesses of order 2 and order 1 have
        self.hash, self.last, self.before = (np.zeros(s, np.uint32) for s in ((2, n), n, n))

    def look(self) -> None:
        np.multiply(self.last, _LAST, out=self.hash[1])
        np.bitwise_xor(self.hash[1], self.before, out=self.hash[0])
        spot = self.hash >> _SHIFT
        spot &= _MASK
        spot *= self.wide
        self.at = spot + self.lane
        self.held = self.slots.take(self.at)
        self.conf = self.held & CONF - 1
        self.guess = self.held >> 3
        self.guess -= 1
        self.which = self.weights.row + self.conf
        self.now = self.weights.flat.take(self.which)
        _, f2, f1 = self.given
        np.multiply(self.now[0], ROOM, out=f2)
        f2 >>= BITS
        np.subtract(ROOM, f2, out=f1)
        f1 *= self.now[1]
        f1 >>= BITS
        f1 *= self.guess[0] != self.guess[1]  # the same guess has one share

    def learn(self, ids: np.ndarray) -> None:
        new = ids + 1
        new <<= 3
        self.held ^= new  # the confidence alone is left of a hit
        self.conf += CONF
        state = np.minimum(self.held, self.conf).astype(np.int64)
        self.weights.learn(self.which, self.now, _AIM_OF.take(state))
        new = new + self.next.take(state)
        self.slots[self.at] = new
        self.before = self.last * _BEFORE
        self.last = ids.astype(np.uint32)


def _seen(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the slots `at` hold when the ids of each row come to them, one after another: (guess + 1) * 16 + 8 * hit + confidence.

    All ids are known, so the rows are sorted by slot instead of being stepped through: a guess is the id that came to the
    same slot before, a confidence the hits in a row up to there."""
    n, size = ids.shape
    key = at << np.uint32(11)
    key |= np.arange(size, dtype=np.uint32)  # BLOCK places have 11 bits
    key.sort(axis=1)
    place = (key & np.uint32(2047)).astype(np.int64)
    place += np.arange(n)[:, None] * size
    place = place.ravel()
    key >>= np.uint32(11)
    key[1::2] |= np.uint32(SLOTS)  # a row's first slot isn't the last one of the row before
    key, came = key.ravel(), ids.ravel().take(place)
    same = key[1:] == key[:-1]
    hit = came[1:] == came[:-1]
    hit &= same
    hit, same = hit.view(np.uint8), same.view(np.uint8)
    row = hit.copy()  # hits in a row, up to CONF - 2
    for _ in range(CONF - 3):
        more = row[:-1] + np.uint8(1)
        more *= hit[1:]
        row[1:] = more
    state = hit << 3
    state[1:] |= row[:-1]
    state *= same
    state += (CONF - 1) * (1 - same)
    out = np.empty(n * size, np.int32)
    out[0] = CONF - 1
    held = out[1:]
    np.add(came[:-1], 1, out=held)
    held *= same.astype(np.int32)
    held <<= 4
    held |= state
    back = np.empty(n * size, np.int32)
    back[place] = out
    return back.reshape(n, size)


def _foreseen(ids: np.ndarray, rows: int = 32) -> np.ndarray:
    """For each step, order and block what the model will have: 16 * (the guesses differ) + 8 * hit + confidence."""
    n, size = ids.shape
    out = np.empty((size, 2, n), np.uint8)
    for s in range(0, n, rows):
        some = ids[s : s + rows]
        last = np.zeros((len(some), size), np.uint32)
        last[:, 1:] = some[:, :-1]
        before = np.zeros_like(last)
        before[:, 1:] = last[:, :-1]
        last *= _LAST
        two, one = _seen(some, (last ^ before * _BEFORE) >> _SHIFT[0] & _MASK), _seen(some, last >> _SHIFT[1] & _MASK)
        differ = (two ^ one > 15).view(np.uint8) << 4
        for k, x in enumerate((two, one)):
            x = x.astype(np.uint8)
            x &= 15
            x |= differ
            out[:, k, s : s + rows] = x.T
    return out


class _Coder:
    """64-bit carryless range coders side by side: a word of 32 bits goes out when it is settled, one a step at most."""

    def __init__(self, n: int):
        self.low = np.zeros(n, np.uint64)
        self.range = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def narrow(self, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """1 for the blocks whose next word is settled, the upper half of `low`; 0 for others. start is overwritten."""
        start *= part
        self.low += start
        np.multiply(part, size, out=self.range)
        return (self.range <= _LOW).astype(np.uint64)

    def go_on(self, due: np.ndarray) -> np.ndarray:
        """Move on to the next word where one is settled; where the interval crosses its border it is cut there. By how many bits."""
        by = due << _FIVE
        self.low <<= by
        self.range <<= by
        self.range -= _ONE
        np.minimum(self.range, ~self.low, out=self.range)
        self.range += _ONE
        return by


def _groups(n: int) -> Iterator[slice]:
    """Blocks coded side by side: few steps of many blocks cost less than many steps of few, so no small rest is left."""
    k = max(1, (n + LANES // 2) // LANES)
    for g in range(k):
        yield slice(n * g // k, n * (g + 1) // k)


def _blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of BLOCK ids, the last one filled up with zeros, and their sizes."""
    n = -(-len(ids) // BLOCK)
    grid = np.zeros(n * BLOCK, np.int32)
    grid[: len(ids)] = ids
    sizes = np.full(n, BLOCK, np.int64)
    sizes[-1] = len(ids) - (n - 1) * BLOCK
    return grid.reshape(n, BLOCK), sizes


def encode_ids(ids: np.ndarray) -> bytes:
    """The header, then blocks one after another: ids and words (counts), crc32 of both, words."""
    if not len(ids):
        return b""
    header, places = _Header.of(ids)
    out = [header.pack()]
    grid, sizes = _blocks(places)
    names = header.ids.astype("<u4")
    for part in _groups(len(grid)):
        g, size = grid[part], sizes[part]
        n, steps = len(g), int(size.max())
        g = g[:, :steps]
        ahead = _foreseen(g)
        weights, coder = _Weights(n), _Coder(n)
        settled = coder.low.view("<u4")[1::2]  # the upper halves
        words, due = np.empty((steps, n), np.uint32), np.empty((steps, n), bool)
        for s in range(0, steps, GROUP):
            some, ids_ = ahead[s : s + GROUP], np.ascontiguousarray(g[:, s : s + GROUP].T)
            which, aim, hit = weights.row + (some & CONF - 1), _AIM.take(some & 15), (some & 8) > 0
            w = np.empty(some.shape, np.int64)
            for k in range(len(some)):
                weights.flat.take(which[k], out=w[k], mode="clip")
                weights.learn(which[k], w[k], aim[k])
            hit2, hit1 = hit[:, 0], hit[:, 1]
            f2, f1 = _shares(w[:, 0], w[:, 1], some[:, 0] > 15)
            base = f2 + f1
            start, width = header.share(ids_, base)
            by1 = hit1 & ~hit2 & (f1 > 0)  # a share of nothing can't be coded: order 0 has the id as well
            _taken(start, width, by1, f2, f1)
            _taken(start, width, hit2, 0, f2)
            start, width = start.view(np.uint64), width.view(np.uint64)
            for k in range(len(some)):
                now = coder.narrow(coder.range >> _BITS, start[k], width[k])
                words[s + k] = settled
                due[s + k] = now
                coder.go_on(now)
        rest = np.stack([coder.low >> _W, coder.low & _LOW], axis=1).astype("<u4")
        # the settled words of one block after another
        at = np.flatnonzero(np.ascontiguousarray(due.T))
        used = np.bincount(at // steps, minlength=n)
        words, to = words.ravel().take(at % steps * n + at // steps).astype("<u4"), np.cumsum(used)
        for k in range(n):
            coded = words[to[k] - used[k] : to[k]].tobytes() + rest[k].tobytes()
            out.append(struct.pack("<III", size[k], used[k] + 2, zlib.crc32(coded, zlib.crc32(names[g[k, : size[k]]].tobytes()))) + coded)
    return b"".join(out)


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of encode_ids(); raises ValueError if a checksum differs."""
    if not data:
        return np.zeros(0, np.uint32)
    header, at = _Header.unpack(data)
    names, whose = header.ids.astype("<u4"), np.repeat(np.arange(len(header.ids), dtype=np.uint16 if len(header.ids) < 1 << 16 else np.int32), header.freq)
    heads = []
    while at < len(data):
        size, used, crc = struct.unpack_from("<III", data, at)
        heads.append((size, used, crc, at + 12))
        at += 12 + 4 * used
    out = []
    both = np.array([[0], [1]])
    kind = np.uint16 if len(header.ids) < (1 << 16) // CONF - 1 else np.int32  # of a slot; half as wide where few ids are different
    for group in _groups(len(heads)):
        some = heads[group]
        n, steps = len(some), max(h[0] for h in some)
        wide = max(h[1] for h in some) + 2
        words = np.zeros((n, wide), np.uint32)
        for k, (_, used, _, p) in enumerate(some):
            words[k, :used] = np.frombuffer(data, "<u4", used, p)
        model, coder = _Model(n, kind), _Coder(n)
        _, f2, f1 = model.given
        by2, by1 = model.given[:2], model.given[1:]  # start and width of what order 2 and order 1 have
        code = words[:, 0].astype(np.uint64) << _W | words[:, 1]
        flat, spot = words.ravel(), np.arange(n) * wide + 2
        places = np.zeros((steps, n), kind)
        for got in places:
            model.look()
            base = f2 + f1
            rest = TOTAL - base
            part = coder.range >> _BITS
            v = code - coder.low
            v //= part
            v = v.view(np.int64)
            by_model, by_two = v < base, v < f2
            v -= base
            v <<= header.bits
            v += (1 << header.bits) - 1
            # places out of range come from damaged words alone, or where a guess is taken: they are clipped
            q = v.view(np.uint64) // rest.view(np.uint64)
            np.copyto(got, whose.take(q.view(np.int64), mode="clip"))
            share = header.edge.take(got + both)
            share *= rest
            share >>= header.bits
            share[1] -= share[0]
            share[0] += base
            for taken, guess, theirs in ((by_model, model.guess[1], by1), (by_two, model.guess[0], by2)):
                np.copyto(got, guess, where=taken)
                np.copyto(share, theirs, where=taken)
            due = coder.narrow(part, *share.view(np.uint64))
            code <<= coder.go_on(due)
            word = flat.take(spot, mode="clip")
            spot += due.view(np.int64)
            due *= word
            code |= due
            model.learn(got)
        turned = np.ascontiguousarray(places.T)
        for k, (size, used, crc, p) in enumerate(some):
            ids = names[turned[k, :size]]
            if zlib.crc32(data[p : p + 4 * used], zlib.crc32(ids.tobytes())) != crc:
                raise ValueError("a block's checksum differs")
            out.append(ids)
    return np.concatenate(out).astype(np.uint32)


_CHUNK = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("payload", pa.binary())])
_CHUNK_DDL = "part int, seq long, before long, n_tokens long, doc_ids array<long>, doc_lens array<long>, payload binary"


def _writer(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list[np.ndarray] = []
        held: list[np.ndarray] = []
        lens: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids, doc, size = np.concatenate(held), np.concatenate(docs), np.concatenate(lens)
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((part, seq, before, len(ids), doc, size, encode_ids(ids)), _CHUNK)], schema=_CHUNK)

        for b in slices(batches, "text", 1 << 22):
            ids, to = with_end(*encoder(path).encode(b.column("text")), end_id)
            docs.append(b.column("doc_id").to_numpy())
            held.append(ids)
            lens.append(np.diff(to))
            if sum(map(len, held)) >= CHUNK:
                row = close()
                yield row
                seq, before = seq + 1, before + row.column("n_tokens")[0].as_py()
                docs, held, lens = [], [], []
        if held:
            yield close()

    return write


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, name: str = "ids") -> DataFrame:
    """The chunks of all documents in ascending doc_id order, as written to the shared folder and read back."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(rows.mapInArrow(_writer(tokenizer, end_id), _CHUNK_DDL), name, **{"compression": "none", "parquet.block.size": str(16 << 20)})


_DOC = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "payload", 1 << 20):
        for r in range(b.num_rows):
            c = {k: b.column(k)[r].as_py() for k in ("part", "before", "doc_ids", "doc_lens", "payload")}
            data = decode_ids(c["payload"]).astype("<u4").tobytes()
            to = np.concatenate([[0], np.cumsum(c["doc_lens"])]).tolist()
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(to[:-1], to[1:])]
            cols = [pa.array(c["doc_ids"], pa.int64()), pa.array([c["part"]] * len(crc), pa.int32()), pa.array([c["before"] + s for s in to[:-1]], pa.int64()), pa.array(c["doc_lens"], pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=_DOC)


def read_ids(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files. Null texts are empty: the end id alone."""
    totals = chunks.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    # a row for each file that the writer made: as many as it had partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    docs = chunks.mapInArrow(_read, "doc_id long, part int, inside long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
