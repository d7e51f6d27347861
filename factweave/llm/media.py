"""Operator 7: media columns: audio stored losslessly, and its features as fixed-shape tensors with time spans.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are
the samples of an 8-bit mono WAV file. Features come from the file read back:
polyphase resampling by UP/DOWN, overlapped Hann frames, log-mel filterbanks,
and active segments by hysteresis on frame energy. The log-mel rows are cut
into blocks of one fixed shape, kept as an Arrow fixed-shape tensor column
beside the time span of each block.

Null and empty texts are 64 zero bytes. Equal texts give equal values: each
text is computed alone, in chunks whose bounds depend on its length only.
Repeated rows give repeated rows; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.llm.common import documents_text, map_arrow, slices

RATE, UP, DOWN, TAPS = 8000, 1, 2, 16
FRAME, HOP, MELS = 256, 128, 16
BLOCK = 32
CHUNK_FRAMES = 2048
HIGH_DB, LOW_DB = 0.5, -1.5
FLOOR = np.float32(-12.0)

DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FULL = "doc_id long, n_bytes long, media binary, tensors binary, segments array<struct<start:double,end:double>>"


def payload(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "replace")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM file, whose samples are the bytes themselves."""
    pad = len(samples) % 2
    head = b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples + bytes(pad)


def from_wav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) of an 8-bit mono PCM file; chunks in any order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate or RATE, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass filter, as one row of taps for each of the up phases."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    h = h.reshape(taps, up).T
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling: each output sample takes only the taps of its phase."""
    phases = _phases(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for p in range(min(up, n)):  # outputs p, p+up, ...: one phase each
        phase, first = (p * down) % up, (p * down) // up
        out[p::up] = windows[first :: down][: len(out[p::up])] @ phases[phase][::-1]
    return out


@lru_cache(8)
def _mel(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a frame."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel rows, frame energies in dB) of overlapped Hann frames; the last frame is padded."""
    frames = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)]) if (frames - 1) * HOP + FRAME > len(x) else x
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:frames]
    hann, mel = np.hanning(FRAME).astype(np.float32), _mel(rate)
    rows, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, CHUNK_FRAMES):
        part = view[a : a + CHUNK_FRAMES] * hann
        spectrum = np.fft.rfft(part, axis=1)
        rows[a : a + CHUNK_FRAMES] = np.log(np.maximum((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ mel, np.float32(np.exp(FLOOR))))
        energy[a : a + CHUNK_FRAMES] = 10 * np.log10(np.maximum(np.einsum("ij,ij->i", part, part), 1e-9))
    return rows, energy


def active(energy: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> np.ndarray:
    """(first, last + 1) frames of segments that begin above mean + high dB and end below mean + low dB."""
    level = energy - energy.mean()
    state = np.where(level >= high, 1, np.where(level < low, -1, 0))
    state[0] = state[0] or -1
    at = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), 0))
    on = np.r_[False, state[at] > 0, False]
    return np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)


def blocks(rows: np.ndarray, rate: int) -> pa.RecordBatch:
    """Log-mel rows as BLOCK x MELS tensors, the last one padded with the floor, with their time spans in seconds."""
    n = -(-len(rows) // BLOCK)
    padded = np.full((n * BLOCK, MELS), FLOOR, np.float32)
    padded[: len(rows)] = rows
    first = np.arange(n) * BLOCK
    last = np.minimum(first + BLOCK, len(rows)) - 1
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(padded.reshape(n, BLOCK, MELS)))
    return pa.RecordBatch.from_arrays([tensor, pa.array(first * HOP / rate), pa.array((last * HOP + FRAME) / rate)], ["log_mel", "start", "end"])


def features(media: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(log-mel rows, active segments, rate) of a stored file."""
    rate, samples = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    rate = rate * UP // DOWN
    rows, energy = log_mel(resample(x), rate)
    return rows, active(energy), rate


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def stored(text: str) -> tuple[int, bytes, bytes, list[dict[str, float]]]:
    """(unpadded bytes, media file, tensors as an Arrow stream, active segments in seconds) of a text."""
    n, samples = payload(text)
    media = to_wav(samples)
    rows, segments, rate = features(media)
    return n, media, _ipc(blocks(rows, rate)), [{"start": a * HOP / rate, "end": ((b - 1) * HOP + FRAME) / rate} for a, b in segments.tolist()]


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media file, tensors as an Arrow stream, active segments in seconds)."""
    span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
    types = [pa.int64(), pa.binary(), pa.binary(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                columns = list(zip(*map(stored, texts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "media", "tensors", "segments"])

    return map_arrow(documents_text(docs), run, FULL)


def digest_row(n: int, media: bytes, tensors: bytes, segments: list[dict[str, float]]) -> tuple:
    """What a stored row is told by: samples read back from the file, tensors from their stream."""
    samples = from_wav(media)[1]
    with pa.ipc.open_stream(tensors) as stream:
        made = stream.read_all()
    tensor = np.concatenate([c.to_numpy_ndarray() for c in made.column("log_mel").chunks])
    quantised = np.round(tensor * 100).astype("<i2")
    spans = np.array([[x["start"], x["end"]] for x in segments], "<f8")
    feature = f"{MELS}x{BLOCK}x{len(quantised)}:{len(segments)}:{made.column('end')[-1].as_py():.3f}:{float(tensor.mean()):.3f}:{hashlib.sha256(quantised.tobytes() + spans.tobytes()).hexdigest()[:32]}"
    return n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digest(docs: DataFrame) -> DataFrame:
    """Sizes, hashes and a feature string of each document's stored media: all from the columns of store()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            columns = list(zip(*(digest_row(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "media", "tensors", "segments"))))))
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *names])

    return map_arrow(store(docs), run, DIGEST)
