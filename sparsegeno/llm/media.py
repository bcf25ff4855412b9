"""Media columns: texts stored as WAV samples, read back, and fingerprinted.

The bytes of a document become an 8-bit mono WAV file (written and read by the wave
module). A short-time Fourier transform of the samples gives spectral peaks; pairs of
peaks close in time give codes, stored with the frame in which each pair starts.

Defined results: a null or empty text is 64 zero bytes of silence with no peaks. Equal
texts give equal values: nothing depends on the neighbours of a row. Long texts are
transformed a block of frames at a time, so working memory is bounded by the file
itself. Extra columns are ignored.
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

RATE = 8000
#: Samples in a frame, and from one frame to the next.
FRAME, HOP = 512, 256
#: Bins are cut into bands at these edges; each band has one candidate peak a frame.
BANDS = (1, 9, 25, 65, 129, 257)
#: A peak exceeds its neighbours in time and this many times the frame's mean.
LOUD = 2.0
#: Each peak is paired with the next FAN peaks at most REACH frames away.
FAN, REACH = 3, 63
BLOCK = 4096

_window = np.hanning(FRAME)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and these padded by zeros to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % 64 or (0 if data else 64))


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectrogram(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Magnitudes of the short-time Fourier transform, a block of frames at a time."""
    x = samples.astype(np.float64) - 128.0
    # silence up to a whole number of hops, so that the last samples lie in a frame
    x = np.pad(x, (0, FRAME - x.size if x.size < FRAME else -(x.size - FRAME) % HOP))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for i in range(0, len(frames), BLOCK):
        yield np.abs(np.fft.rfft(frames[i : i + BLOCK] * _window, axis=1))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, in order of time and then frequency."""
    bins, heights, means = [], [], []
    for mag in spectrogram(samples):
        means.append(mag[:, 1:].mean(axis=1))
        at = [mag[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:], strict=False)]
        bins.append(np.stack(at, 1))
        heights.append(np.take_along_axis(mag, bins[-1], 1))
    where, height, mean = np.concatenate(bins), np.concatenate(heights), np.concatenate(means)
    before = np.vstack([np.zeros((1, height.shape[1])), height[:-1]])
    after = np.vstack([height[1:], np.zeros((1, height.shape[1]))])
    is_peak = (height > before) & (height >= after) & (height > LOUD * mean[:, None]) & (height > 1e-9)
    t, band = np.nonzero(is_peak)
    return t.astype(np.int64), where[t, band].astype(np.int64)


def pair_codes(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded fingerprints: start frames and codes of 9 + 9 + 6 bits (both bins, distance)."""
    times, codes, order = [], [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        i = np.nonzero(near)[0]
        times.append(t[i])
        codes.append(f[i] << 15 | f[i + k] << 6 | gap[i])
        order.append(i * FAN + k)
    by = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(times)[by].astype(np.int32), np.concatenate(codes)[by].astype(np.int32)


def features(samples: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    t, f = peaks(samples)
    return len(t), *pair_codes(t, f)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, media (WAV), and the fingerprint arrays ``times`` and ``codes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                media = [write_wav(payload_of(x.as_py())[1]) for x in part.column(1)]
                marks = [features(np.frombuffer(read_wav(m), np.uint8))[1:] for m in media]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(media, pa.binary()),
                        pa.array([m[0] for m in marks], pa.list_(pa.int32())),
                        pa.array([m[1] for m in marks], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "media", "times", "codes"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, media binary, times array<int>, codes array<int>"
    )


def _digest(text: str | None) -> tuple:
    n, payload = payload_of(text)
    media = write_wav(payload)
    back = read_wav(media)
    found, times, codes = features(np.frombuffer(back, np.uint8))
    mark = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
    return (
        n,
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-64:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        f"{found}:{len(codes)}:{mark}",
    )


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: lengths and digests of what was stored and read back, and the feature."""
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
