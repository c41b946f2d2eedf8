"""Audio features of 8-bit samples: polyphase resampling, log-mel frames, energy segments.

A payload is stored as an 8-bit mono WAV file and read back from those bytes.
Features are fixed-shape Arrow tensors of ``FRAMES`` x ``BANDS`` log-mel values
with their time spans (the last tensor padded with the floor value), kept as an
Arrow IPC stream in a binary column. All steps walk a signal in blocks, so
memory is bounded by the samples, one byte each, and one block of frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, without

RATE, UP, DOWN = 16_000, 2, 3
WINDOW, HOP, BANDS, FRAMES = 256, 128, 24, 64
TAPS = 8
#: dB over the median at which a segment starts, and to which it lasts.
START_DB, STAY_DB = 3.0, 0.5
FLOOR_DB = -100.0
_BLOCK = 4096


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + bytes(n % 2)


def read_wav(media: bytes) -> tuple[int, memoryview]:
    """Rate and samples of an 8-bit mono WAV file; other files raise ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, view = 12, 0, memoryview(media)
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        if kind == b"data":
            return rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def _phases(up: int, down: int) -> np.ndarray:
    """Low-pass taps, a row for each output phase."""
    top = max(up, down)
    n = TAPS * top
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / top) * np.hamming(n)
    taps *= up / taps.sum()
    rows = -(-n // up)
    return np.pad(taps, (0, rows * up - n)).reshape(rows, up).T.astype(np.float32)


def resample(samples: np.ndarray, start: int, stop: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Outputs start..stop-1 of the signal resampled by up/down, from its 8-bit samples; zero outside."""
    bank = _phases(up, down)
    length = bank.shape[1]
    first, last = start * down // up - length + 1, (stop - 1) * down // up + 1
    block = np.zeros(last - first, np.float32)
    a, b = max(first, 0), min(last, len(samples))
    if b > a:
        block[a - first : b - first] = (samples[a:b].astype(np.float32) - 128) / 128
    out = np.empty(stop - start, np.float32)
    for r in range(up):
        n0 = start + (r - start) % up
        if n0 >= stop:
            continue
        count = (stop - 1 - n0) // up + 1
        base = n0 * down // up - first
        taps = bank[n0 * down % up]
        windows = np.lib.stride_tricks.sliding_window_view(block, length)[base - length + 1 :: down][:count]
        out[n0 - start :: up] = windows @ np.ascontiguousarray(taps[::-1])
    return out


@lru_cache
def _mel(rate: int) -> np.ndarray:
    """Triangular filters, (bins, bands)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), BANDS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(WINDOW, 1 / rate)
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    up, down = (bins[:, None] - low) / (mid - low), (high - bins[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int = RATE):
    """Blocks of (frames, BANDS) log-mel dB and their energies, over the resampled signal."""
    total = -(-len(samples) * UP // DOWN)
    frames = max(1, -(-(total - WINDOW) // HOP) + 1)
    shape, filters = np.hanning(WINDOW + 1)[:-1].astype(np.float32), _mel(rate * UP // DOWN)
    for f in range(0, frames, _BLOCK):
        g = min(frames, f + _BLOCK)
        part = resample(samples, f * HOP, (g - 1) * HOP + WINDOW)
        cut = np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::HOP] * shape
        power = np.square(np.abs(np.fft.rfft(cut, axis=1))).astype(np.float32)
        yield 10 * np.log10(np.maximum(power @ filters, 1e-10)), 10 * np.log10(np.maximum(np.square(cut).mean(1), 1e-10))


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that stay above the lower threshold and reach the upper one."""
    middle = float(np.median(energy))
    on = np.flatnonzero(np.diff(np.concatenate(([0], energy > middle + STAY_DB, [0])).astype(np.int8)))
    peaks = energy >= middle + START_DB
    return [(int(a), int(b)) for a, b in on.reshape(-1, 2) if peaks[a:b].any()]


TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, BANDS])
_SCHEMA = pa.schema([("log_mel", TENSOR), ("start_s", pa.float64()), ("stop_s", pa.float64())])


def features(media: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """Arrow IPC stream of the tensors with their spans, and the segments' spans in seconds."""
    rate, data = read_wav(media)
    samples = np.frombuffer(data, np.uint8)
    parts = list(log_mel(samples, rate))
    mel, energy = np.concatenate([m for m, _ in parts]), np.concatenate([e for _, e in parts])
    step = HOP * DOWN / UP / rate
    n, count = len(mel), -(-len(mel) // FRAMES)
    flat = np.full((count * FRAMES, BANDS), FLOOR_DB, np.float32)
    flat[:n] = mel
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), FRAMES * BANDS))
    starts = np.arange(count) * FRAMES * step
    stops = np.minimum(starts + FRAMES * step, n * step)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([tensors, pa.array(starts), pa.array(stops)], schema=_SCHEMA))
    return sink.getvalue().to_pybytes(), [(a * step, b * step) for a, b in segments(energy)]


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def store(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``media``, the WAV file of each text's padded UTF-8 bytes (null: empty)."""

    @F.arrow_udf("binary")
    def media(texts: pa.Array) -> pa.Array:
        return pa.array([write_wav(padded((x or "").encode("utf-8", "surrogatepass"))) for x in texts.to_pylist()], pa.binary())

    return docs.withColumn("media", media(F.col("text")))


def analyse(media: DataFrame) -> DataFrame:
    """``media`` rows plus ``tensors`` (Arrow IPC stream) and ``spans`` of segments; a null media gives nulls; columns of these names are replaced."""

    @F.arrow_udf("struct<tensors:binary,spans:array<struct<start_s:double,stop_s:double>>>")
    def run(files: pa.Array) -> pa.Array:
        kind = pa.struct([("tensors", pa.binary()), ("spans", pa.list_(pa.struct([("start_s", pa.float64()), ("stop_s", pa.float64())])))])
        out = []
        for x in files.to_pylist():
            if x is None:
                out.append({"tensors": None, "spans": None})
                continue
            tensors, spans = features(x)
            out.append({"tensors": tensors, "spans": [{"start_s": a, "stop_s": b} for a, b in spans]})
        return pa.array(out, kind)

    (found,) = fresh(media, "found")
    rest = without(media, "tensors", "spans")
    return media.withColumn(found, run(F.col("media"))).select(*rest, F.col(found)["tensors"].alias("tensors"), F.col(found)["spans"].alias("spans"))


def feature_text(stream: bytes, spans: list[tuple[float, float]]) -> str:
    """Tensors, mean dB of eight groups of bands over the real frames, and segments, as text."""
    tensors = read_tensors(stream)
    values = tensors.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, BANDS)
    seconds = tensors.column("stop_s")[-1].as_py()
    n = round(seconds * RATE * UP / DOWN / HOP)
    means = values[:n].mean(0, dtype=np.float64).reshape(8, -1).mean(1)
    spoken = sum(b - a for a, b in spans)
    return f"{len(tensors)}x{FRAMES}x{BANDS} {seconds:.3f}s [{','.join(f'{x:.1f}' for x in means)}] {len(spans)} segments {spoken:.3f}s"


_DIGEST = "struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"


def digest(text: Column) -> Column:
    """Stores a text as media, reads it back and returns its digests and its features as text.

    A null or empty text is 64 zero bytes; equal texts give equal values; the
    longest text needs a few times its bytes in memory.
    """

    @F.arrow_udf(_DIGEST)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts.to_pylist():
            data = (x or "").encode("utf-8", "surrogatepass")
            media = write_wav(padded(data))
            _, payload = read_wav(media)
            rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(*features(media))))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return run(text)
