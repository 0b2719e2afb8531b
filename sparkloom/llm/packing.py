"""Packing by non-negative least squares over shallow length combinations.

Every document is cut into full windows and a remainder. The remainders' histogram (at most window-1 numbers) is
matched by combinations of two or three lengths that fill a window: repeat counts come from non-negative least squares,
are rounded down and repaired so that no length is used more often than it occurs. What no combination takes up is laid
end to end greedily and cut at window borders. The last, unfilled window is split into powers of two, so nothing pads.

Null texts are empty and still have the end id; an empty table gives no piece; equal lengths are dealt by doc_id. A very
long text is many full windows, cut in one worker. Rows that repeat a doc_id, or have none, are documents each, told
apart by `row` (the place where they were read). Further columns of docs aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, running_start, shuffle_partitions, slices
from .tokens import encoder, with_end

WINDOW = 1024
#: Widest gap between lengths that a triple is built from; its third length closes the window exactly.
TRIPLE_STEP = 32
ROUNDS = 400


def combinations(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs and triples of the given lengths that fill the window exactly."""
    have = set(lengths.tolist())
    out = [(a, window - a) for a in lengths.tolist() if a <= window - a and window - a in have]
    coarse = lengths[:: max(1, len(lengths) // TRIPLE_STEP)].tolist()
    out += [(a, b, window - a - b) for i, a in enumerate(coarse) for b in coarse[i:] if b <= window - a - b and window - a - b in have]
    return sorted(set(out))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with least |a x - b|, by accelerated projected gradients."""
    step = 1 / max(1e-9, np.linalg.norm(a, 2) ** 2)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination is used; never more of a length than the histogram has."""
    lengths = np.array(sorted(histogram), np.int64)
    combos = combinations(lengths, window) if len(lengths) else []
    if not combos:
        return []
    at = {n: k for k, n in enumerate(lengths.tolist())}
    a = np.zeros((len(lengths), len(combos)))
    for j, c in enumerate(combos):
        for n in c:
            a[at[n], j] += 1
    left = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    counts = np.floor(nnls(a, left.astype(float)) + 1e-6).astype(np.int64)
    out: dict[tuple[int, ...], int] = {}
    for greedy in (False, True):  # the rounded counts, then what they left over
        for j in sorted(range(len(combos)), key=lambda j: (-counts[j], j)):
            most = min(left[at[n]] // combos[j].count(n) for n in combos[j])
            take = int(most if greedy else min(most, counts[j]))
            if take:
                out[combos[j]] = out.get(combos[j], 0) + take
                for n in combos[j]:
                    left[at[n]] -= take
    return sorted(out.items())


_CUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("full", pa.list_(pa.binary())), ("rest", pa.binary())])
_CUT_DDL = "row long, doc_id long, n long, full array<binary>, rest binary"


def _cutter(path: str, end_id: int, window: int, with_ids: bool):
    """Full windows (their ids, or the crc32 of these as four bytes) and the ids of the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text", 1 << 22):
            ids, to = with_end(*encoder(path).encode(b.column("text")), end_id)
            data = memoryview(ids.astype("<u4").tobytes())
            full, rest = [], []
            for s, e in zip(to[:-1].tolist(), to[1:].tolist()):
                middle = s + (e - s) // window * window
                some = [data[4 * k : 4 * (k + window)] for k in range(s, middle, window)]
                full.append([bytes(x) if with_ids else zlib.crc32(x).to_bytes(4) for x in some])
                rest.append(bytes(data[4 * middle : 4 * e]))
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column("doc_id"), pa.array(np.diff(to)), pa.array(full, pa.list_(pa.binary())), pa.array(rest, pa.binary())], schema=_CUT)

    return cut


_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tail(total: int, window: int) -> list[int]:
    """Borders of the sequences of the last, unfilled window: powers of two, largest first."""
    sizes = [1 << k for k in range(window.bit_length() - 1, -1, -1) if total >> k & 1]
    return np.cumsum([0, *sizes]).tolist()


def _laid(window: int, base: int, whole: int, borders: list[int], with_ids: bool):
    """Pieces of remainders: `seq` says where a combination put one whole, `pos` where the stream of the others has it."""
    last = np.array(borders, np.int64)
    schema = pa.schema([*_PIECE, ("ids", pa.binary())] if with_ids else _PIECE)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, rest, seq, off, pos in zip(*(b.column(k).to_pylist() for k in ("doc_id", "n", "rest", "seq", "off", "pos"))):
                begin, size = n - len(rest) // 4, len(rest) // 4
                if seq is not None:
                    rows.append((doc, begin, size, zlib.crc32(rest), n, seq, off, rest))
                    continue
                done = 0
                while done < size:
                    at = pos + done
                    if at < whole * window:
                        s, o, room = at // window, at % window, window - at % window
                    else:
                        k = int(np.searchsorted(last, at - whole * window, "right")) - 1
                        s, o, room = whole + k, at - whole * window - borders[k], borders[k + 1] - (at - whole * window)
                    take = min(room, size - done)
                    ids = rest[4 * done : 4 * (done + take)]
                    rows.append((doc, begin + done, take, zlib.crc32(ids), n, base + s, o, ids))
                    done += take
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), schema)], schema=schema)

    return lay


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the piece's ids (little-
    endian 32-bit): a sequence is its pieces' ids in order of offset. Every id lies in one piece."""
    spark = docs.sparkSession
    buckets = 2 * shuffle_partitions(spark)
    cut = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cutter(tokenizer, end_id, window, with_ids), _CUT_DDL), "pack")
    sizes = cut.select("row", "doc_id", "n")

    # full windows: dense sequence ids from the numbers of windows before each document
    full = running_start(cut.select("row", "doc_id", "n", "full").where(F.col("n") >= window), F.floor(F.col("n") / window), ["doc_id", "row"], "first", buckets)
    crc = F.crc32("x") if with_ids else F.conv(F.hex("x"), 16, 10).cast("long")
    whole_pieces = full.select("doc_id", "n", "first", F.posexplode("full").alias("k", "x")).select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), crc.alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *([F.col("x").alias("ids")] if with_ids else [])
    )

    rest = sizes.select("row", "doc_id", (F.col("n") % window).alias("r")).where("r > 0").withColumn("b", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)))
    # counts by length and hash bucket: (window-1) * buckets rows at most, whatever the corpus
    counts = rest.groupBy("r", "b").agg(F.count("*").alias("c"))
    histogram = {x["r"]: x["c"] for x in counts.groupBy("r").agg(F.sum("c").alias("c")).collect()}
    windows_before = sizes.agg(F.coalesce(F.sum(F.floor(F.col("n") / window)), F.lit(0)).alias("w")).first()["w"]

    chosen = plan(histogram, window)
    base, slots, used = windows_before, [], dict.fromkeys(histogram, 0)
    for combo, times in chosen:
        off = 0
        for n in combo:
            slots.append((n, used[n], used[n] + times, base, off))
            used[n] += times
            off += n
        base += times
    # rank of a document among those with its length: bucket totals before it, then doc_id order inside the bucket
    before = Window.partitionBy("r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("r", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("r", "b").orderBy("doc_id", "row")
    ranked = rest.withColumn("i", F.row_number().over(inside) - 1).join(offsets, ["r", "b"]).select("row", "doc_id", "r", (F.col("i") + F.col("ahead")).alias("rank"))
    slot_rows = spark.createDataFrame(slots, "r long, lo long, hi long, seq0 long, off long")
    # three rows a combination at most; the number of combinations depends on the window alone
    placed = ranked.join(F.broadcast(slot_rows), (ranked.r == slot_rows.r) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").select(
        "row", "doc_id", ranked.r, (F.col("seq0") + F.col("rank") - F.col("lo")).alias("seq"), "off"
    )
    loose_tokens = sum(n * (c - used[n]) for n, c in histogram.items())
    loose = running_start(placed.where("seq is null").select("row", "doc_id", "r"), "r", ["doc_id", "row"], "pos", buckets)
    where = placed.where("seq is not null").select("row", "seq", "off", F.lit(None).cast("long").alias("pos")).unionByName(
        loose.select("row", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("off"), "pos")
    )
    lay = _laid(window, base, loose_tokens // window, _tail(loose_tokens % window, window), with_ids)
    rest_pieces = cut.select("row", "doc_id", "n", "rest").join(where, "row").drop("row").mapInArrow(lay, _PIECE_DDL + (", ids binary" if with_ids else ""))
    return whole_pieces.unionByName(rest_pieces)
