"""Media columns: WAV payloads, short-time Fourier transforms, spectral-peak pair fingerprints.

Method
  A text's UTF-8 bytes, followed by zero bytes up to a positive multiple of 64,
  are the samples of an 8-bit mono WAV written by the `wave` module. The
  stored form is read back, cut into Hann-windowed frames and transformed.
  Silence before and after lets frames overlap over the first and last sample too,
  and there are at least two frames.
  The strongest bin of each of four frequency bands is a peak; every peak is paired with
  all peaks of the next three frames, and a pair's code holds both bins and
  their distance. Codes and the frames they start at are two equally long
  arrays. The feature string names their numbers and a digest of both.

One text is worked on at a time, a bounded number of frames at once, so equal
texts give equal values wherever they stand; rows leave in blocks of about four megabytes of text.

Defined results: a null or empty text has a payload of 64 zero bytes. Very long texts are transformed whole. Of
equally strong bins of a band the lowest is the peak.
Repeated rows give repeated results; an empty table gives no rows; columns besides doc_id and text are
ignored, whatever their names; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.store import read_table, trimmed
from quern.llm.words import blocks

UNIT = 64
RATE = 8000
FRAME, HOP = 256, 192
#: The bins of the four frequency bands.
BANDS = ((1, 16), (16, 40), (40, 80), (80, 129))
REACH = 3
SILENCE = b"\x80"
_FRAMES = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """The strongest bin of each band, a row for each frame."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - np.float32(128)
    if len(samples) < FRAME:
        samples = np.concatenate([samples, np.zeros(FRAME - len(samples), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS)), np.int32)
    for a in range(0, len(frames), _FRAMES):
        power = np.abs(np.fft.rfft(frames[a : a + _FRAMES] * _WINDOW, axis=1))
        for band, (low, high) in enumerate(BANDS):
            out[a : a + _FRAMES, band] = power[:, low:high].argmax(axis=1) + low
    return out


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and codes of all peak pairs, in frame order."""
    lap = FRAME - HOP  # the window is nothing at the ends of a frame
    hops = max(1, -(-(len(payload) + 2 * lap - FRAME) // HOP))
    top = peaks((SILENCE * lap + payload).ljust(FRAME + hops * HOP, SILENCE))
    times, codes = [], []
    for gap in range(1, REACH + 1):
        a, b = top[:-gap], top[gap:]
        times.append(np.repeat(np.arange(len(a), dtype=np.int32), len(BANDS) ** 2))
        codes.append((a[:, :, None] << 16 | b[:, None, :] << 8 | gap).reshape(-1))
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(times, kind="stable")
    return times[order], codes[order]


def _features(outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "text")):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                stored = to_wav(raw + b"\0" * (-len(raw) % UNIT or (UNIT if not raw else 0)))
                payload = from_wav(stored)
                t, c = fingerprint(payload)
                digest = hashlib.blake2b(t.astype("<i4").tobytes() + c.astype("<i4").tobytes(), digest_size=16).hexdigest()
                row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), f"stft{FRAME}:{len(t)}:{digest}")
                rows.append(row + tuple({"media": stored, "times": t, "codes": c}[n] for n in outputs))
            kinds = {"media": pa.binary(), "times": pa.list_(pa.int32()), "codes": pa.list_(pa.int32())}
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *outputs]
            text = ("payload_sha256", "media_sha256", "feature")
            columns = [pa.array([r[i] for r in rows], kinds.get(n, pa.string() if n in text else pa.int64())) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return run


def media_features(docs: DataFrame, *, outputs: tuple[str, ...] = ("media", "times", "codes")) -> DataFrame:
    """The digest columns of op4 and the outputs asked for: media binary; times and codes array<int>, the time-coded fingerprint."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    more = {"media": "binary", "times": "array<int>", "codes": "array<int>"}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_features(outputs)), schema + "".join(f", {n} {more[n]}" for n in outputs))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read_table(spark, sf_dir, "documents"), outputs=("times", "codes"))
