"""Media columns: lossless 8-bit audio and features of what is read back from it.

A payload of bytes becomes a mono WAV file of 8-bit samples.  Features are computed from
the samples that are read back: polyphase resampling to 5/8 of the rate, overlapping
log-mel filterbank frames, and energy segments with hysteresis.  Frames are laid out as
fixed-shape Arrow tensors of `TENSOR_FRAMES` x `MELS` (the last one padded with the floor
value), each with its time span and number of real frames, in an Arrow IPC stream.

Every sample is in some frame: the last frame is padded with silence.  Each document is
computed by itself, with array shapes that depend on its length only, so that equal texts
give equal bytes.  Null is the empty text, whose payload is one unit of spaces.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import blocks, quoted

UNIT = 192
TAIL = 16
RATE = 16_000
UP, DOWN = 5, 8
TAPS = 12
FRAME, HOP, FFT = 250, 100, 256
MELS = 40
TENSOR_FRAMES = 64
FLOOR = 1e-6
#: Decibels over the median frame at which a segment opens, and at which it closes.
OPEN_DB, CLOSE_DB = 1.0, 0.25


def payload_of(text: bytes) -> bytes:
    """The text, padded with spaces to a positive multiple of UNIT bytes."""
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono PCM; chunks have an even length."""
    body = samples + b"\0" * (len(samples) % 2)
    return b"".join(
        [b"RIFF", struct.pack("<I", 36 + len(body)), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8), b"data", struct.pack("<I", len(samples)), body]
    )


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of such a file; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of both rates, cut into `up` phases of 2 * taps + 1 coefficients."""
    width = max(up, down)
    half = taps * up
    t = np.arange(-half, half + up) / width
    h = np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(np.arange(-half, half + up) / (half + up), -1, 1))) * up / width
    return h.reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up / down times its rate: each output takes the one filter phase that meets real samples."""
    phases = _phases(up, down, taps)
    size = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps, np.float32), x, np.zeros(taps + 2 + down, np.float32)])
    out = np.zeros(size, np.float32)
    for k in range(min(up, size)):
        first, phase = divmod(k * down, up)
        begin, count = first + (phase > 0), len(range(k, size, up))
        acc = np.zeros(count, np.float32)
        for j, c in enumerate(phases[(-phase) % up]):
            acc += c * padded[begin + j : begin + j + (count - 1) * down + 1 : down]
        out[k::up] = acc
    return out


@lru_cache(8)
def _filterbank(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).T.astype(np.float32)


_WINDOW = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows of all frames, and each frame's energy in decibels."""
    count = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.zeros((count - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] * _WINDOW
    spectrum = np.fft.rfft(frames, FFT)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    return np.log(np.maximum(power @ _filterbank(rate), FLOOR)).astype(np.float32), 10 * np.log10(np.maximum((frames * frames).sum(axis=1), FLOOR))


def energy_segments(energy: np.ndarray) -> np.ndarray:
    """(first, after last) frames of segments: one opens at OPEN_DB over the median and closes below CLOSE_DB over it."""
    level = np.median(energy)
    mark = np.where(energy >= level + OPEN_DB, 1, np.where(energy < level + CLOSE_DB, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (at >= 0) & (mark[at] > 0), [False]])
    return np.stack([np.flatnonzero(~on[:-1] & on[1:]), np.flatnonzero(on[:-1] & ~on[1:])], 1)


@dataclass(frozen=True)
class Features:
    """Of one recording; spans are in seconds."""

    tensors: np.ndarray
    frames: np.ndarray
    spans: np.ndarray
    segments: np.ndarray
    count: int

    def to_arrow(self) -> bytes:
        """An Arrow IPC stream: tensor (fixed shape), frames, start_s, end_s."""
        flat = pa.FixedSizeListArray.from_arrays(pa.array(self.tensors.ravel()), TENSOR_FRAMES * MELS)
        kind = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS], dim_names=["frame", "mel"])
        batch = pa.RecordBatch.from_arrays(
            [pa.ExtensionArray.from_storage(kind, flat), pa.array(self.frames), pa.array(self.spans[:, 0]), pa.array(self.spans[:, 1])], ["tensor", "frames", "start_s", "end_s"]
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()


def feature_digest(stream: bytes, segments: np.ndarray) -> str:
    """Frames, tensors and segments, and a hash of all values, as read back from an Arrow stream of tensors."""
    with pa.ipc.open_stream(stream) as read:
        batch = read.read_next_batch()
    tensors, frames = batch.column(0).storage.flatten().to_numpy(), batch.column(1).to_numpy()
    every = hashlib.sha256()
    for a in (tensors, frames, batch.column(2).to_numpy(), batch.column(3).to_numpy(), segments):
        every.update(np.ascontiguousarray(a).tobytes())
    return f"{int(frames.sum())}x{MELS};{len(frames)};{len(segments)};{every.hexdigest()}"


def features_of(media: bytes) -> Features:
    """Features of a WAV file's samples."""
    rate, samples = read_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    low = rate * UP // DOWN
    mel, energy = log_mel(resample(x), low)
    n = len(mel)
    tensors = np.full((-(-n // TENSOR_FRAMES), TENSOR_FRAMES, MELS), np.float32(np.log(FLOOR)), np.float32)
    tensors.reshape(-1, MELS)[:n] = mel
    first = np.arange(len(tensors)) * TENSOR_FRAMES
    frames = np.minimum(n - first, TENSOR_FRAMES)
    spans = np.stack([first * HOP / low, ((first + frames - 1) * HOP + FRAME) / low], 1)
    segments = energy_segments(energy)
    return Features(tensors, frames, spans, np.stack([segments[:, 0] * HOP / low, ((segments[:, 1] - 1) * HOP + FRAME) / low], 1), n)


def _texts(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    for block in blocks(column):
        raw, at = block.data.tobytes(), block.offsets.tolist()
        for k in range(block.count):
            yield block.first + k, raw[at[k] : at[k + 1]]


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, media (the WAV file), tensors (Arrow IPC stream) and segments (seconds) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for batch in batches:
            for k, raw in _texts(batch.column(1)):
                media = write_wav(payload_of(raw))
                found = features_of(media)
                segments = pa.array([[{"start_s": a, "end_s": b} for a, b in found.segments.tolist()]], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([media]), pa.array([found.to_arrow()]), segments], [key, "media", "tensors", "segments"])

    picked = docs.select(quoted(key), quoted(text))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, media binary, tensors binary, segments array<struct<start_s: double, end_s: double>>")


def media_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sizes, hashes and feature digest of every document's media; one pass, no shuffle, media are not kept."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names[1:]]
            for _, raw in _texts(batch.column(1)):
                media = write_wav(payload_of(raw))
                back = read_wav(media)[1]
                found = features_of(media)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature_digest(found.to_arrow(), found.segments))
                for kept, value in zip(rows, row, strict=True):
                    kept.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows, kinds, strict=True))], names)

    picked = docs.select(quoted(key), quoted(text))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
