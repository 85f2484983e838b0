"""Audio columns: lossless storage, resampling, log-mel features and voiced segments.

A payload is stored as 8-bit mono PCM in a WAVE container and read back from it. Samples are resampled by a polyphase
filter (windowed sinc, `UP`/`DOWN`), framed with overlap, and turned into log-mel energies; frames group into tensors
of a fixed shape with their time spans. Segments come from frame energies with two thresholds: one opens at the upper
and closes at the lower. Blocks of frames bound the memory for long payloads.

Defined results: a null text is an empty payload, padded to 64 zero bytes; equal payloads give equal values.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywright.llm.common import append

RATE, UP, DOWN, TAPS = 16000, 2, 3, 16
FRAME, HOP, MELS, TENSOR = 256, 128, 32, 64
#: Samples that are resampled at once, a multiple of DOWN so that a block starts at an output.
BLOCK = DOWN << 16


def pad(data: bytes, to: int = 64) -> bytes:
    return data + b"\0" * (-len(data) % to if data else to)


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _filter() -> np.ndarray:
    """Low-pass taps at the lower of both rates, dealt to the `UP` phases: row p serves outputs of phase p."""
    n = 2 * TAPS * max(UP, DOWN) + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    h *= UP / h.sum()
    h = np.r_[h, np.zeros(-n % UP)]
    return h.reshape(-1, UP).T[:, ::-1].astype(np.float32)


def _mel_bank(rate: float) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).astype(np.float32)


_PHASES, _BANK, _WINDOW = _filter(), _mel_bank(RATE * UP / DOWN), np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Output m is phase (m * DOWN) % UP of the filter at input (m * DOWN) // UP; outputs of one phase lie UP apart."""
    taps = _PHASES.shape[1]
    padded = np.r_[np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)]
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(-(-len(x) * UP // DOWN), np.float32)
    for first in range(UP):
        mine = out[first::UP]
        mine[:] = view[first * DOWN // UP :: DOWN][: len(mine)] @ _PHASES[first * DOWN % UP]
    return out


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames x MELS; the last frame is filled up with zeros."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    x = np.r_[samples, np.zeros(max(0, (n - 1) * HOP + FRAME - len(samples)), np.float32)]
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    out = [np.log(np.abs(np.fft.rfft(frames[k : k + 2048] * _WINDOW)).astype(np.float32) ** 2 @ _BANK + 1e-6) for k in range(0, n, 2048)]
    return np.concatenate(out)


def segments(energy: np.ndarray, upper: float = 0.5, lower: float = -0.5) -> list[tuple[int, int]]:
    """Frame ranges that open where the energy, in deviations from its mean, is over `upper` and close under `lower`."""
    z = (energy - energy.mean()) / (energy.std() + 1e-6)
    state = np.where(z > upper, 1, np.where(z < lower, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(z)), -1))
    on = np.r_[0, np.where(last >= 0, state[last], 0) == 1, 0].astype(np.int8)
    edge = np.flatnonzero(np.diff(on))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def analyse(payload: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (n x TENSOR x MELS), their time spans, and segments in seconds. Blocks of samples are resampled with
    the filter's reach on both sides."""
    reach, parts = _PHASES.shape[1] * DOWN, []
    for lo in range(0, len(payload), BLOCK):
        before = min(lo, reach)
        x = (np.frombuffer(payload[lo - before : lo + BLOCK + reach], np.uint8).astype(np.float32) - 128) / 128
        y = resample(x)
        n = -(-min(BLOCK, len(payload) - lo) * UP // DOWN)
        parts.append(y[before * UP // DOWN :][:n])
    mel = log_mel(np.concatenate(parts))
    second = HOP * DOWN / (RATE * UP)
    n = -(-len(mel) // TENSOR)
    tensors = np.full((n * TENSOR, MELS), np.float32(np.log(1e-6)), np.float32)
    tensors[: len(mel)] = mel
    spans = [(k * TENSOR * second, min((k + 1) * TENSOR, len(mel)) * second) for k in range(n)]
    return tensors.reshape(n, TENSOR, MELS), spans, [(a * second, b * second) for a, b in segments(mel.mean(axis=1))]


def arrow_tensors(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream with a column of fixed-shape tensors and one of time spans."""
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))
    starts, ends = (pa.array([s[k] for s in spans], pa.float64()) for k in (0, 1))
    batch = pa.RecordBatch.from_arrays([column, starts, ends], names=["log_mel", "start_s", "end_s"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def audio(docs: DataFrame, text: str = "text", keep: list[str] | None = None, with_media: bool = False) -> DataFrame:
    """Digests of what is stored and read back, and of the features; with_media: the stored forms as columns too."""

    def fn(texts: pa.Array) -> list:
        out = []
        for raw in texts.cast(pa.binary()).to_pylist():
            raw = raw or b""
            media = store(pad(raw))
            back = load(media)
            tensors, spans, found = analyse(back)
            stream = arrow_tensors(tensors, spans)
            read = pa.ipc.open_stream(stream).read_all()
            values = read["log_mel"].combine_chunks().to_numpy_ndarray()
            rounded = np.round(values, 2) + 0.0
            feature = f"{values.shape[0]}x{TENSOR}x{MELS}:{len(found)}:{sum(b - a for a, b in found):.3f}:{hashlib.sha256(rounded.tobytes()).hexdigest()[:32]}"
            row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature]
            out.append(row + [media, stream, [{"start_s": a, "end_s": b} for a, b in found]] * with_media)
        return list(map(list, zip(*out, strict=True)))

    more = ", media binary, tensors binary, segments array<struct<start_s:double,end_s:double>>" * with_media
    return append(docs, [text], "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + more, fn, keep)
