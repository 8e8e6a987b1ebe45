"""Media columns: bytes kept as WAV sound, read back by the wave module, and fingerprinted by spectral-peak pairs.

A payload is a text's UTF-8 (null: empty) with zero bytes up to the next positive multiple of 64. It is stored as mono
8-bit samples of a WAV file, one byte a sample, so nothing is lost. Features come from the samples that the file gives back:

* short-time Fourier transforms: FRAME samples under a Hann window every HOP samples (the last frame is filled with silence),
* peaks: bins that are not silent and not less than any in their neighbourhood of 2 * NEAR_FRAMES + 1 frames by
  2 * NEAR_BINS + 1 bins; of equal ones less than NEAR_BINS apart in a frame the lowest is the peak,
* landmarks: each peak with the FAN next peaks at most REACH frames later, as the time-coded long
  frame << 22 | bin << 14 | other bin << 6 | frames between, in order of time.

Each document is transformed on its own, in chunks of CHUNK frames, so equal texts have equal features and spectra take bounded
memory for long ones. Rows repeat as they come; a null doc_id stays null; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, stash

PAD = 64
RATE = 8000
FRAME, HOP = 256, 128
NEAR_FRAMES, NEAR_BINS = 4, 8
FAN, REACH = 3, 63
CHUNK = 4096
BINS = FRAME // 2 + 1
WINDOW = np.hanning(FRAME).astype(np.float32)
#: Output rows per Arrow batch are bounded by this many bytes of media.
BATCH_BYTES = 8 << 20


def payload(text: bytes) -> bytes:
    return text + bytes(max(1, -(-len(text) // PAD)) * PAD - len(text))


def encode(samples: bytes) -> bytes:
    """A WAV file of mono 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples expected")
        return r.readframes(r.getnframes())


def _magnitudes(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Spectra of frames first..last-1, rounded so that a last bit of the transform can't move a peak."""
    part = samples[first * HOP : (last - 1) * HOP + FRAME]
    signal = np.zeros((last - first - 1) * HOP + FRAME, np.float32)
    signal[: len(part)] = (part.astype(np.float32) - 128) / 128
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    spectrum = np.fft.rfft(frames * WINDOW, axis=1)
    return np.round(np.abs(spectrum) * 256).astype(np.int32)


def _spread(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The greatest value within reach along axis, by doubling."""
    out, have = x, 0
    while have < reach:
        step = min(have + 1, reach - have)
        wide = out.copy()
        a, b = (slice(step, None), slice(None, -step)) if axis == 0 else ((slice(None), slice(step, None)), (slice(None), slice(None, -step)))
        np.maximum(wide[a], out[b], out=wide[a])
        np.maximum(wide[b], out[a], out=wide[b])
        out, have = wide, have + step
    return out


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, in order."""
    total = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    frames, bins = [], []
    for first in range(0, total, CHUNK):
        lo, hi = max(0, first - 2 * NEAR_FRAMES), min(total, first + CHUNK + 2 * NEAR_FRAMES)
        m = _magnitudes(samples, lo, hi)
        greatest = _spread(_spread(m, NEAR_FRAMES, 0), NEAR_BINS, 1)
        f, b = np.nonzero((m == greatest) & (m > 0))
        own = (f >= first - lo) & (f < first - lo + CHUNK)
        frames.append(f[own] + lo)
        bins.append(b[own])
    f, b = np.concatenate(frames), np.concatenate(bins)
    if len(f) > 1:  # of a run of equal peaks in one frame's neighbourhood keep the first
        later = np.r_[False, (f[1:] == f[:-1]) & (b[1:] - b[:-1] <= NEAR_BINS)]
        f, b = f[~later], b[~later]
    return f, b


def landmarks(samples: np.ndarray) -> np.ndarray:
    """The time-coded pairs of peaks."""
    f, b = peaks(samples)
    codes = []
    for fan in range(1, FAN + 1):
        gap = f[fan:] - f[:-fan]
        near = gap <= REACH
        codes.append((f[:-fan] << 22 | b[:-fan] << 14 | b[fan:] << 6 | gap)[near])
    return np.sort(np.concatenate(codes).astype(np.int64))


MEDIA = "doc_id long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_peak_pairs long, feature string, landmarks array<long>"


def _batched(rows, names: list[str], types: list[pa.DataType]):
    """Batches of rows, which come with their sizes in bytes, of about BATCH_BYTES."""
    flush = lambda some: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*some), types)], names)
    held, size = [], 0
    for row, more in rows:
        held.append(row)
        size += more + 400
        if size > BATCH_BYTES:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def _encode(batches):
    def rows():
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                raw = (text.as_py() or "").encode()
                media = encode(payload(raw))
                yield (doc_id.as_py(), len(raw), media), len(media)

    return _batched(rows(), ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()])


def media_column(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes of the text, and media, a WAV file of its payload."""
    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode, MEDIA)


def stored_media(docs: DataFrame) -> DataFrame:
    """media_column() written to the shared folder; what reads it reads the stored bytes back."""
    return stash(media_column(docs), compression="zstd")


def _fingerprint(batches):
    long, text = pa.int64(), pa.string()

    def rows():
        for batch in batches:
            for doc_id, n_bytes, stored in zip(batch["doc_id"], batch["n_bytes"], batch["media"]):
                media = stored.as_py()
                back = decode(media)
                codes = landmarks(np.frombuffer(back, np.uint8))
                feature = f"{len(codes)}:{hashlib.sha256(codes.tobytes()).hexdigest()[:32]}"
                row = (doc_id.as_py(), n_bytes.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), len(codes), feature, codes)
                yield row, 8 * len(codes)

    return _batched(rows(), [x.split(" ")[0] for x in SCHEMA.split(", ")], [long, long, long, text, long, long, text, long, text, pa.list_(long)])


def fingerprints(media: DataFrame) -> DataFrame:
    """Per row of media (doc_id, n_bytes, media): sizes and digests of payload and file as read back, and the time-coded landmarks."""
    return bound_batches(media).select("doc_id", "n_bytes", "media").mapInArrow(_fingerprint, SCHEMA)
