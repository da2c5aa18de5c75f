"""Media columns (operator 1): WAV bytes to spectral-peak pair fingerprints.

A binary column of WAV files is read with the ``wave`` module (8-, 16-, 24- and 32-bit PCM, channels
averaged), cut into Hann-windowed frames of ``FRAME`` samples every ``HOP`` samples (a short last frame is padded with silence), and transformed.
A peak is a cell of the log power spectrum that is the greatest of its neighbourhood (``REACH_TIME``
frames by ``REACH_BIN`` bins, the earliest and lowest of equals) and exceeds the mean of its frame by ``FLOOR``.  Each
peak is paired with the next ``FAN`` peaks within ``SPAN`` frames; a pair's 32-bit code is
(bin, other bin, frames between), and its time is the frame of the first peak.  The fingerprint is a
pair of arrays of equal length, codes and times, ordered by time.

Defined cases: null bytes give null results; bytes that are no PCM WAV file, and samples of over 32 bits, give a row
with an ``error`` and null arrays, never a failed job; of equal cells in one neighbourhood (silence, pure tones) the first is the peak; a file without samples or without peaks has empty arrays; recordings of any length are
read whole, and transformed chunk by chunk; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

FRAME, HOP, REACH_TIME, REACH_BIN, FLOOR, FAN, SPAN = 512, 256, 3, 7, 1.5, 3, 32
RATE = 8000
CHUNK_FRAMES = 1024
WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)
SCHEMA = "id long, sample_rate int, n_samples long, duration double, n_peaks long, codes array<long>, times array<int>, error string"


def wav_of(text: Column | str) -> Column:
    """A mono 8-bit WAV file whose samples are the UTF-8 bytes of ``text``: media for tables that hold none."""
    data = F.encode(text, "UTF-8")

    def little(n: Column) -> Column:
        h = F.lpad(F.hex(n), 8, "0")
        return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))

    size = F.octet_length(data)
    ascii_ = lambda s: F.encode(F.lit(s), "US-ASCII")
    head = F.unhex(F.lit("100000000100" + "0100" + RATE.to_bytes(4, "little").hex() * 2 + "01000800"))
    return F.concat(ascii_("RIFF"), little(size + size % 2 + 36), ascii_("WAVEfmt "), head, ascii_("data"), little(size), data, F.when(size % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))


def samples(file: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples in -1 .. 1 of a WAV file."""
    with wave.open(io.BytesIO(file)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        if width > 4 or rate >= 1 << 31:
            raise wave.Error(f"samples of {width} bytes, {rate} a second")
        raw = w.readframes(w.getnframes())
    raw = raw[: len(raw) - len(raw) % (width * channels)]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def spectrum(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Log power of frames first .. last - 1, (frames, FRAME // 2 + 1)."""
    part = x[first * HOP : (last - 1) * HOP + FRAME]
    part = np.pad(part, (0, (last - first - 1) * HOP + FRAME - len(part)))
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * WINDOW
    f = np.fft.rfft(frames, axis=1)
    return np.log(f.real**2 + f.imag**2 + np.float32(1e-6)).astype(np.float32)


def n_frames(n: int) -> int:
    return 0 if n == 0 else 1 + max(0, -(-(n - FRAME) // HOP))


def _running_max(a: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Maximum over reach cells on either side."""
    a = np.moveaxis(a, axis, 0)
    size = 2 * reach + 1
    pad = np.full((reach, *a.shape[1:]), -np.inf, dtype=a.dtype)
    m = np.concatenate([pad, a, pad])
    have = 1
    while have < size:
        step = min(have, size - have)
        m = np.maximum(m[:-step], m[step:])
        have += step
    return np.moveaxis(m, 0, axis)


def peaks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of every peak, by frame and bin; memory is that of a chunk of frames."""
    total = n_frames(len(x))
    times, bins = [], []
    for low in range(0, total, CHUNK_FRAMES):
        high = min(low + CHUNK_FRAMES, total)
        a, b = max(0, low - 2 * REACH_TIME), min(total, high + 2 * REACH_TIME)
        s = spectrum(x, a, b)
        top = _running_max(_running_max(s, REACH_BIN, 1), REACH_TIME, 0)
        t, f = np.nonzero((s == top) & (s > s.mean(axis=1, keepdims=True) + FLOOR))
        # of equal cells in one neighbourhood the first stays
        keep = np.ones(len(t), dtype=bool)
        for step in range(1, len(t)):
            close = (t[step:] - t[:-step] <= REACH_TIME) & (np.abs(f[step:] - f[:-step]) <= REACH_BIN)
            if not (t[step:] - t[:-step] <= REACH_TIME).any():
                break
            keep[step:] &= ~close
        inside = keep & (t + a >= low) & (t + a < high)
        times.append(t[inside] + a)
        bins.append(f[inside])
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    return join(times), join(bins)


def pairs(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and times of all pairs, by time, then first and second peak."""
    codes, times, order = [], [], []
    for step in range(1, FAN + 1):
        gap = t[step:] - t[:-step]
        ok = np.flatnonzero(gap <= SPAN)
        codes.append(f[:-step][ok] << 20 | f[step:][ok] << 8 | gap[ok])
        times.append(t[:-step][ok])
        order.append(ok * FAN + step)
    by = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(codes)[by], np.concatenate(times)[by].astype(np.int32)


def fingerprint(file: bytes | None) -> tuple:
    """(sample_rate, n_samples, duration, n_peaks, codes, times, error) of one file."""
    if file is None:
        return (None,) * 7
    try:
        rate, x = samples(bytes(file))
    except (wave.Error, EOFError, ValueError, RuntimeError) as e:  # RuntimeError: a chunk that claims to be larger than the file
        return (*(None,) * 6, f"{type(e).__name__}: {e}"[:200])
    t, f = peaks(x)
    codes, times = pairs(t, f)
    return rate, len(x), len(x) / rate if rate else None, len(t), codes, times, None


def fingerprints(media: DataFrame, id_column: str = "doc_id", wav_column: str = "wav") -> DataFrame:
    """One row per row of ``media``: the columns of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("sample_rate", pa.int32()), ("n_samples", pa.int64()), ("duration", pa.float64()), ("n_peaks", pa.int64()), ("codes", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("error", pa.string())])
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = [fingerprint(w.as_buffer() if w.is_valid else None) for w in part.column(1)]
                columns = [part.column(0), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(7))]
                yield pa.record_batch(columns, schema=schema)

    return tx.map_batches(media.select(F.col(id_column).cast("long").alias("id"), F.col(wav_column).alias("wav")), run, SCHEMA).withColumnRenamed("id", id_column)
