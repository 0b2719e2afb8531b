"""Media columns: WAV bytes, short-time Fourier transforms, spectral-peak pair fingerprints.

A payload is stored as an 8-bit mono WAV and read back with the wave module. Frames of `FRAME` samples every `HOP`
give a magnitude spectrum; a frame's peaks are its strongest local maxima. Each peak is paired with the strongest peak
of its own and of the following frames; a pair is one long: frame << 32 | bin << 18 | other bin << 4 | frames apart.

Null or empty bytes are a payload of padding only. Equal bytes give equal values; rows are independent, ties among
peaks go to the lower bin. Texts of any length are stored and read whole, one at a time. Rows that repeat a doc_id each give
their row; an empty table gives an empty one; further columns, also of the result's names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

FRAME, HOP, RATE = 576, 288, 8000
PEAKS, REACH = 3, 3
BLOCK = 2048  # frames transformed at a time
_HANN = np.hanning(FRAME + 1)[:-1]


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectrum(samples: bytes, first: int, last: int) -> np.ndarray:
    """Magnitudes of frames first..last-1, as whole numbers so that equal frames give equal peaks everywhere."""
    x = np.frombuffer(samples, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[first * HOP : (last - 1) * HOP + 1 : HOP]
    return np.rint(np.abs(np.fft.rfft((view - 128.0) * _HANN, axis=1)) * 16).astype(np.int64)


def peaks(mag: np.ndarray) -> np.ndarray:
    """The bins of each frame's strongest local maxima, strongest first; -1 where there are fewer."""
    mid = mag[:, 1:-1]
    top = (mid > mag[:, :-2]) & (mid >= mag[:, 2:])
    # the strength and, inverted, the bin in one number: ties go to the lower bin
    key = np.where(top, mid * 1024 + (1023 - np.arange(1, mag.shape[1] - 1)), -1)
    best = -np.sort(-np.partition(key, key.shape[1] - PEAKS, axis=1)[:, -PEAKS:], axis=1)
    return np.where(best >= 0, 1023 - best % 1024, -1)


def fingerprints(samples: bytes) -> np.ndarray:
    n = (len(samples) - FRAME) // HOP + 1
    at = np.concatenate([peaks(spectrum(samples, k, min(n, k + BLOCK))) for k in range(0, n, BLOCK)])
    same = (at[:, 1:] >= 0) & (at[:, :1] >= 0)
    codes = [((np.arange(n)[:, None] << 32) | (at[:, 1:] << 18) | (at[:, :1] << 4))[same]]  # within a frame
    for dt in range(1, min(REACH, n - 1) + 1):
        one, two = at[:-dt], at[dt:, :1]
        code = (np.arange(len(one))[:, None] << 32) | (one << 18) | (two << 4) | dt
        codes.append(code[(one >= 0) & (two >= 0)])
    return np.sort(np.concatenate(codes))


_MEDIA = pa.schema([("_sl_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("codes", pa.list_(pa.int64()))])


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_sl_text", 1 << 22):
        raw, off = utf8(b.column("_sl_text"))
        data = [raw[off[k] : off[k + 1]].tobytes() for k in range(b.num_rows)]
        wavs = [to_wav(pad(d)) for d in data]
        cols = [b.column("_sl_id"), pa.array([len(d) for d in data], pa.int64()), pa.array(wavs, pa.binary()), pa.array([fingerprints(from_wav(w)) for w in wavs], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, schema=_MEDIA)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (the WAV), codes (the time-coded fingerprints): one row a document."""
    out = docs.select(F.col(id_col).alias("_sl_id"), F.col(text_col).alias("_sl_text"))
    return out.mapInArrow(_media, "_sl_id long, n_bytes long, media binary, codes array<long>").withColumnRenamed("_sl_id", id_col)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_fingerprints", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "media", 1 << 22):
        rows = []
        for doc, n, wav, code in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), b.column("codes")):
            got, code = from_wav(wav), code.values.to_numpy(zero_copy_only=False).astype("<i8")
            sha = [hashlib.sha256(x).hexdigest() for x in (got, wav, code.tobytes())]
            rows.append((doc, n, len(got), sha[0], zlib.crc32(got[-32:]), len(wav), sha[1], sha[2], len(code)))
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), _DIGEST)], schema=_DIGEST)


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of media_columns(): every stored WAV is read back first."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_fingerprints long"
    return media_columns(docs).mapInArrow(_digest, ddl)
