"""WAV bytes: durations from the chunks of a file, deterministic test audio, and one file from many."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plectrum.functions.text import units
from plectrum.session import small_batches

RATE = 8000
#: Silence below this amplitude; lengths in milliseconds before and after the sound, and of the fades.
SILENCE, HEAD_MS, TAIL_MS, FADE_MS = 0.002, 20, 50, 5


def chunks_of(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, offset, size) of the chunks of a RIFF file, as their headers say."""
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def duration_ms(data: bytes | None) -> int | None:
    """From the byte rate and the data chunk; null for anything else, which is never guessed."""
    if data is None or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    rate = size = 0
    for name, at, n in chunks_of(data):
        if name == b"fmt " and at + 12 <= len(data):
            rate = struct.unpack_from("<I", data, at + 8)[0]
        elif name == b"data":
            size = min(n, len(data) - at)
    return math.floor(size / rate * 1000 + 0.5) if rate and size else None


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of samples (frames, channels) between -1 and 1; louder ones are clipped."""
    clipped = np.clip(samples, -1, 1)
    pcm = np.trunc(np.where(clipped < 0, clipped * 0x8000, clipped * 0x7FFF)).astype("<i2").tobytes()
    return header(len(pcm), rate, samples.shape[1]) + pcm


def header(size: int, rate: int, channels: int = 1) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", size)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (frames, channels) and the rate of a 16-bit PCM file."""
    parts = {name: (at, n) for name, at, n in chunks_of(data)}
    at = parts[b"fmt "][0]
    channels, rate = struct.unpack_from("<HI", data, at + 2)
    begin, n = parts[b"data"]
    pcm = np.frombuffer(data, "<i2", min(n, len(data) - begin) // 2, begin)
    return pcm[: len(pcm) // channels * channels].reshape(-1, channels) / 32768.0, rate


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation between neighbouring frames."""
    if rate == to or not len(samples):
        return samples
    place = np.arange(math.ceil(len(samples) * to / rate)) * (rate / to)
    low = np.minimum(np.floor(place).astype("i8"), len(samples) - 1)
    part = (place - low)[:, None]
    return samples[low] * (1 - part) + samples[np.minimum(low + 1, len(samples) - 1)] * part


def joined(files: list[bytes]) -> bytes:
    """One file of all in a row, at the highest rate and with the most channels; mono goes to every channel."""
    if not files:
        raise ValueError("nothing to export")
    read = [decode(f) for f in files]
    rate, channels = max(r for _, r in read), max(s.shape[1] for s, _ in read)
    out = []
    for samples, own in read:
        wide = resampled(samples, own, rate)
        out.append(wide[:, [0 if wide.shape[1] == 1 else min(c, wide.shape[1] - 1) for c in range(channels)]])
    return encode(np.concatenate(out), rate)


def trimmed(samples: np.ndarray, rate: int) -> np.ndarray:
    """Without the silence at both ends but for some padding, faded in and out; the first channel decides."""
    loud = np.flatnonzero(np.abs(samples[:, 0]) >= SILENCE)
    if not len(loud):
        return samples
    low = max(0, loud[0] - math.floor(rate * HEAD_MS / 1000 + 0.5))
    high = min(len(samples) - 1, loud[-1] + math.floor(rate * TAIL_MS / 1000 + 0.5))
    out = samples[low : high + 1].copy()
    n = max(1, rate * FADE_MS // 1000)
    for i in range(min(n, len(out))):
        out[i] *= math.sin(math.pi / 2 * i / n)
        out[len(out) - 1 - i] *= math.cos(math.pi / 2 * i / n)
    return out


def mock_seconds(text: Column) -> Column:
    return F.least(F.lit(3.0), F.greatest(F.lit(1.0), units(text) * F.lit(0.01)))


def tone(text: str) -> bytes:
    """Test audio of a text: a swelling tone of 1 to 3 seconds whose pitch comes from the text's hash."""
    seconds = min(3.0, max(1.0, len(text.encode("utf-16-le")) // 2 * 0.01))
    pitch = 180 + hashlib.sha256(text.encode()).digest()[1] % 140
    t = np.arange(math.floor(RATE * seconds)) / RATE
    wave = np.sin(2 * np.pi * pitch * t) * 9000 * (0.7 + 0.3 * np.sin(2 * np.pi * 3 * t))
    pcm = np.floor(wave + 0.5).astype("<i2").tobytes()
    return header(len(pcm), RATE) + pcm


def with_audio(df: DataFrame, text: str) -> DataFrame:
    """df plus audio: test audio of a text; a blank text has none."""

    @F.pandas_udf("binary")
    def synthesise(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: tone(t) if t and t.strip() else None)

    small_batches(df.sparkSession)
    return df.withColumn("audio", synthesise(F.col(text)))


def durations(audio: Column) -> Column:
    """The duration of each file in milliseconds."""

    @F.pandas_udf("long")
    def read(files: pd.Series) -> pd.Series:
        return files.map(duration_ms).astype("Int64")

    return read(audio)


def export(chunks: DataFrame) -> DataFrame:
    """doc_id, audio: the chunks (doc_id, chunk, audio) of each document as one file, in order."""

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        files = [f for f in group.sort_values("chunk")["audio"] if f is not None]
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "audio": [joined(files)] if files else [None]})

    small_batches(chunks.sparkSession)
    kind = chunks.schema["doc_id"].dataType.simpleString()
    return chunks.select("doc_id", "chunk", "audio").groupBy("doc_id").applyInPandas(whole, f"doc_id {kind}, audio binary")
