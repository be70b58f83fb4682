"""Audio features of 8-bit PCM media.

A media column holds WAV files (mono, unsigned 8-bit samples). Features: polyphase resampling, overlapped log-mel
filterbanks, and energy segments with hysteresis (a segment opens above one level and closes below a lower one). Each
segment's log-mel frames are pooled to a fixed shape and stored as a fixed-shape Arrow tensor beside its time span.

Payload of a text: its UTF-8 bytes, then bytes 0 up to a positive multiple of 64. Null text is read as empty. Equal
payloads have equal features, repeated rows equal results. Frames are made in blocks, so working memory beyond the
samples is bounded; a very long text is one signal. Zeros follow the signal, so every sample is well inside a frame;
time spans end with the signal. A signal whose levels are all alike has at most one segment. An empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import map_columns

BLOCK = 64
RATE, UP, DOWN = 8000, 1, 2
TAPS = 16
FRAME, HOP = 256, 128
MELS, SLOTS = 20, 8
OPEN_DB, CLOSE_DB = 0.3, -0.3
BLOCK_FRAMES = 4096


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[int, bytes]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.getframerate(), w.readframes(w.getnframes())


@lru_cache
def _low_pass(up: int, down: int) -> np.ndarray:
    n = np.arange(TAPS * max(up, down)) - (TAPS * max(up, down) - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hamming(len(n))
    return (h * up / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: every output phase has its own sub-filter; no zero-stuffed signal is ever made. The filter's delay is
    taken off, so that the last samples count as much as others."""
    h = _low_pass(up, down)
    delay = len(h) // 2 // down
    n = delay - (-len(x) * up // down)
    y = np.zeros(n, np.float32)
    for first in range(up):
        where = np.arange(first, n, up)
        if not len(where):
            continue
        phase = first * down % up
        sub = h[phase::up]
        start = first * down // up
        if down == 2 and up == 1:
            # Both branches of the filter run at the output rate.
            even, odd = x[0::2], x[1::2]
            a = np.convolve(even, sub[0::2])[:n]
            b = np.convolve(odd, sub[1::2])[: max(0, n - 1)]
            y[: len(a)] += a
            y[1 : 1 + len(b)] += b
            continue
        full = np.convolve(x, sub)
        at = start + np.arange(len(where)) * down
        y[where] = full[at]
    return y[delay:]


@lru_cache
def _mel(rate: float) -> np.ndarray:
    to = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to(40), to(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames, MELS) and the level in dB of each frame; zeros follow for at least HOP samples, as a frame's last
    samples weigh next to nothing."""
    size = FRAME + HOP * max(0, -(-(len(x) + HOP - FRAME) // HOP))
    x = np.concatenate([x, np.zeros(size - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mels, levels = [], []
    for at in range(0, len(frames), BLOCK_FRAMES):
        part = frames[at : at + BLOCK_FRAMES] * _WINDOW
        levels.append(10 * np.log10(np.einsum("ij,ij->i", part, part) + 1e-6))
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels.append(np.log(power.astype(np.float32) @ _mel(rate) + 1e-6))
    return np.concatenate(mels), np.concatenate(levels)


def segments(levels: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Frame ranges: opened at or above the median plus open_db, closed below the median plus close_db."""
    middle = float(np.median(levels))
    mark = np.where(levels >= middle + open_db, 1, np.where(levels < middle + close_db, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (at >= 0) & (mark[np.maximum(at, 0)] > 0), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def tensor(frames: np.ndarray) -> np.ndarray:
    """A segment's frames averaged into SLOTS slots of equal time."""
    edges = np.linspace(0, len(frames), SLOTS + 1)
    lo = np.minimum(edges[:-1].astype(int), len(frames) - 1)
    hi = np.maximum(np.ceil(edges[1:]).astype(int), lo + 1)
    total = np.concatenate([np.zeros((1, MELS)), np.cumsum(frames, axis=0, dtype=np.float64)])
    return ((total[hi] - total[lo]) / (hi - lo)[:, None]).astype(np.float32)


@lru_cache
def _kind():
    return pa.fixed_shape_tensor(pa.float32(), (SLOTS, MELS))


def features(media: bytes) -> bytes:
    """An Arrow IPC stream: start_s, end_s, log_mel (fixed-shape tensor) of each segment; first the whole signal."""
    rate, data = from_wav(media)
    x = resample((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128)
    rate = rate * UP / DOWN
    mel, levels = log_mel(x, rate)
    spans = [(0, len(mel)), *segments(levels)]
    tensors = np.stack([tensor(mel[a:b]) for a, b in spans])
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([a * HOP / rate for a, _ in spans], pa.float32()),
            pa.array([min((b - 1) * HOP + FRAME, len(x)) / rate for _, b in spans], pa.float32()),
            pa.ExtensionArray.from_storage(_kind(), pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), SLOTS * MELS)),
        ],
        names=["start_s", "end_s", "log_mel"],
    )
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def media(docs: DataFrame) -> DataFrame:
    """Each document's text as a media column: doc_id, n_bytes, media."""

    def make():
        def f(ids, texts):
            made = [payload(t) for t in texts]
            return ids, [n for n, _ in made], [to_wav(p) for _, p in made]

        return f

    return map_columns(docs, ["doc_id", "text"], "doc_id long, n_bytes long, media binary", make)


def featured(rows: DataFrame) -> DataFrame:
    """The media column read back: doc_id, n_bytes, media, features (Arrow IPC), n_segments, end_s, and payload_bytes,
    payload_sha256 and tail_crc32 of the samples that are stored."""

    def make():
        def one(m):
            data = from_wav(m)[1]
            f = features(m)
            t = pa.ipc.open_stream(f).read_all()
            return f, t.num_rows - 1, t["end_s"][0].as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:])

        def f(media):
            return tuple(map(list, zip(*map(one, media), strict=True)))

        return f

    schema = "features binary, n_segments long, end_s double, payload_bytes long, payload_sha256 string, tail_crc32 long"
    return map_columns(rows, ["media"], schema, make, ("doc_id", "n_bytes", "media"))


def digest(rows: DataFrame) -> DataFrame:
    """Digests of stored media and features, by column functions."""
    feature = F.concat_ws(":", F.col("n_segments").cast("string"), F.format_string("%.3f", "end_s"), F.substring(F.sha2("features", 256), 1, 32))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
