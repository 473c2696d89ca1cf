"""Media columns: payloads stored as WAV, read back by the wave module, and fingerprinted.

The short-time Fourier transform of the stored samples gives one spectral peak a frame;
pairs of peaks up to three frames apart are fingerprints, kept in time-coded arrays
(frame, then both frequencies and the distance), and summed up in a short feature.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

UNIT, HOP, RATE = 192, 96, 8000
_REACH = 3
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_HANN = np.hanning(UNIT + 2)[1:-1].astype(np.float32)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as the samples of a WAV file.

    The payload is the UTF-8 text (null: empty) with bytes 32 appended up to a positive
    multiple of 192, one 8-bit mono sample a byte; ``n_bytes`` is its length before that.
    Long texts are stored whole; null ids stay null; repeated rows are stored each; an empty
    table gives an empty table; further columns are ignored, whatever their names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.pieces(batch, "text"):
                texts = pc.fill_null(part.column("text").cast(pa.binary()), b"").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b" ")) for t in texts], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def to_wav(samples: bytes) -> bytes:
    """A mono 8-bit WAV file of ``samples``."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file, as read by the wave module."""
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest frequency bin (1 up) of each frame of 192 samples, every 96 samples."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    found = [np.empty(0, np.int64)]
    for lo in range(0, len(frames), 4096):  # bounded memory for long media
        spectrum = np.fft.rfft((frames[lo : lo + 4096].astype(np.float32) - 128) * _HANN, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        # Coarse steps, so that equal samples give equal peaks in any batch.
        found.append(np.argmax(np.round(np.log2(power[:, 1:] + 1) * 64), axis=1) + 1)
    return np.concatenate(found)


def landmarks(peak: np.ndarray) -> np.ndarray:
    """Time-coded peak pairs: frame << 16 | first bin << 9 | second bin << 2 | distance."""
    time = np.arange(len(peak), dtype=np.int64)
    pairs = [(time[:-d] << 16) | (peak[:-d] << 9) | (peak[d:] << 2) | d for d in range(1, _REACH + 1) if len(peak) > d]
    return np.sort(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)


def feature(marks: np.ndarray, frames: int) -> str:
    """Frames, pairs and four minimum hashes of the pairs regardless of time."""
    if not len(marks):
        return f"{frames}:0:{'f' * 32}"
    codes = (marks & 0xFFFF).astype(np.uint32)
    low = ((codes[:, None] + np.uint32(1)) * _MULTIPLIERS[None, :]).min(axis=0)
    return f"{frames}:{len(marks)}:" + "".join(f"{x:08x}" for x in low)


def describe(stored: DataFrame) -> DataFrame:
    """Digests and fingerprints of stored media, from the bytes read back.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, landmarks``.  Null and empty texts are one unit of spaces; equal
    texts give equal values; long media are transformed a bounded number of frames at a
    time; null ids stay null; repeated rows are described each; an empty table gives an
    empty table; further columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.pieces(batch, "media"):
                rows: list[tuple] = []
                for media in part.column("media").to_pylist():
                    payload = from_wav(media)
                    peak = peaks(np.frombuffer(payload, np.uint8))
                    marks = landmarks(peak)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(marks, len(peak)), marks))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes")] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "landmarks"],
                )

    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, landmarks array<long>")
