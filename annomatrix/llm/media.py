"""Texts as sound: 8-bit WAV columns, short-time Fourier transforms and spectral-peak pair fingerprints.

encode() stores the UTF-8 bytes of a text, padded with spaces to a positive multiple of FRAME, as the samples of a mono
WAV file in a binary column. fingerprint() reads such a column with the wave module. A null or empty text is one frame
of spaces. A null doc_id is kept, and one of any size keeps its bits. Rows are handled one by one, so repeated rows give
repeated results, texts of any length are stored whole, an empty table gives none, and extra columns, whatever their
names, are not read.
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

from .shared import materialize

FRAME = 192
RATE = 8000
WINDOW = 384
BANDS = (1, 8, 20, 48, 96, 193)
FAN_OUT = 3
REACH = 31
AT_ONCE = 4096
ROWS = 500


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (in frames) and frequency bins of the spectral peaks, in order. A frame's strongest bin of each band is a
    peak if no neighbouring frame is stronger in that band; of equal ones the earlier frame wins."""
    hann = np.hanning(WINDOW).astype(np.float32)
    n = len(samples) // FRAME
    padded = np.zeros(n * FRAME + WINDOW - FRAME, dtype=np.float32)
    padded[: n * FRAME] = samples[: n * FRAME].astype(np.float32) - 128
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::FRAME]
    bins = np.zeros((n, len(BANDS) - 1), dtype=np.int64)
    power = np.zeros((n, len(BANDS) - 1), dtype=np.float32)
    for lo in range(0, n, AT_ONCE):
        spectrum = np.fft.rfft(views[lo : lo + AT_ONCE] * hann, axis=1)
        strength = spectrum.real**2 + spectrum.imag**2
        for b, (a, z) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            at = strength[:, a:z].argmax(1)
            bins[lo : lo + AT_ONCE, b] = at + a
            power[lo : lo + AT_ONCE, b] = strength[np.arange(len(at)), at + a]
    high = power > 0
    high[1:] &= power[1:] > power[:-1]
    high[:-1] &= power[:-1] >= power[1:]
    t, b = np.nonzero(high)
    return t, bins[t, b]


def pair_hashes(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each peak with the FAN_OUT peaks behind it, at most REACH frames away: anchor times, and hashes of both bins
    and their distance in time."""
    times, hashes = [], []
    for k in range(1, FAN_OUT + 1):
        dt = t[k:] - t[:-k]
        near = dt <= REACH
        times.append(t[:-k][near])
        hashes.append(((f[:-k] << 16) | (f[k:] << 8) | dt)[near])
    at, code = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((code, at))
    return at[order], code[order]


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % FRAME or FRAME * (not data))


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the WAV file of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                data = [b"" if t is None else t.encode() for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array([to_wav(padded(d)) for d in data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def fingerprint(stored: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, media) the payload's and the file's checksums, and the fingerprint as two arrays:
    times (in frames) and hashes of peak pairs."""
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, times array<int>, hashes array<int>"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                found = []
                for cell in part.column("media"):
                    media = cell.as_py()
                    data = from_wav(media)
                    at, code = pair_hashes(*peaks(np.frombuffer(data, dtype=np.uint8)))
                    sums = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest())
                    found.append((*sums, at.astype(np.int32), code.astype(np.int32)))
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """encode(), written to the shared folder and read back."""
    return materialize(encode(docs), "media")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a stored WAV, read back; feature is a digest of the fingerprint arrays."""
    found = fingerprint(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    codes = F.transform(F.arrays_zip("times", "hashes"), lambda p: F.concat_ws(":", p["times"], p["hashes"]))
    feature = F.concat(F.size("hashes").cast("string"), F.lit("-"), F.sha2(F.array_join(codes, ","), 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
