"""Audio columns: 8-bit samples, polyphase resampling, log-mel frames and energy segments.

A payload is kept losslessly as 8-bit mono PCM in a WAV container.  Features are
computed from the samples read back: a rational polyphase resampler, overlapped
Hann frames, a mel filterbank in decibels, and segments of sound by an energy gate
with hysteresis (a segment opens at the upper threshold and closes at the lower).
Segments are cut into spans of ``TENSOR_FRAMES`` frames and stored as a fixed-shape
Arrow tensor column with begin and end times.

Each clip is worked on by itself, so equal clips have equal features.  What takes many
times a clip's size (windows, spectra) is made in blocks of ``BLOCK_FRAMES`` frames; the
payload, its WAV form and the log-mel frames (less than the payload) are held whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_batch, ddl

RATE, UP, DOWN = 12_000, 2, 3
#: Taps of each polyphase branch.
TAPS = 12
FRAME, HOP, MELS = 256, 128, 20
BLOCK_FRAMES = 2048
PAD_BYTE, PAD_TO = 255, 576
#: Energies over a clip's own median, in decibels, that open and close a segment.
OPEN_DB, CLOSE_DB = 1.5, 0.5
TENSOR_FRAMES = 16
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes filled up with 255 to a positive multiple of 576, bytes before that)."""
    data = (text or "").encode("utf-8")
    size = max(1, -(-len(data) // PAD_TO)) * PAD_TO
    return data.ljust(size, bytes([PAD_BYTE])), len(data)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM with a WAV header; an odd number of bytes is followed by the pad byte of the format."""
    pad = len(payload) & 1
    return _HEADER.pack(b"RIFF", _HEADER.size - 8 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a WAV file with 8-bit mono PCM."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache
def resampling_filter(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass as ``up`` branches of ``TAPS`` taps, each of sum 1."""
    n = up * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = (np.sinc(cut * t) * np.hamming(n)).reshape(TAPS, up).T
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


@lru_cache
def mel_filters(rate: float) -> np.ndarray:
    """Triangles (bins x MELS) of even spacing on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def resampled(samples: np.ndarray, first: int, count: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``count`` samples of the resampled clip from ``first`` on; outside of the clip is silence."""
    h = resampling_filter(up, down)
    at = (first + np.arange(count)) * down
    centre, branch = at // up, at % up
    begin = int(centre[0]) - TAPS // 2 + 1
    end = int(centre[-1]) + TAPS // 2 + 1
    part = np.zeros(end - begin, np.float32)
    low, high = max(begin, 0), min(end, len(samples))
    if low < high:
        part[low - begin : high - begin] = (samples[low:high].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)[centre - centre[0]]
    out = np.empty(count, np.float32)
    for b in range(up):
        own = branch == b
        out[own] = windows[own] @ h[b, ::-1]
    return out


def log_mel_blocks(samples: np.ndarray, rate: int = RATE) -> Iterator[np.ndarray]:
    """Log-mel frames (n x MELS, decibels) of a clip, block by block."""
    length = -(-len(samples) * UP // DOWN)
    frames = max(1, 1 + -(-(length - FRAME) // HOP))
    window = np.hanning(FRAME).astype(np.float32)
    filters = mel_filters(rate * UP / DOWN)
    for at in range(0, frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, frames - at)
        y = resampled(samples, at * HOP, (n - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(cut * window, axis=1)).astype(np.float32) ** 2
        yield 10 * np.log10(power @ filters + 1e-6)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) frames of sound: from a frame at OPEN_DB over the median on, back to where CLOSE_DB was passed, until under CLOSE_DB."""
    over = energy - np.median(energy)
    loud, quiet = over >= OPEN_DB, over < CLOSE_DB
    edges = np.flatnonzero(np.diff(np.concatenate(([1], quiet.astype(np.int8), [1]))))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if loud[a:b].any()]


def clip_features(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(log-mel frames, segments) of a stored clip."""
    payload, rate = from_wav(media)
    mel = np.concatenate(list(log_mel_blocks(np.frombuffer(payload, np.uint8), rate)))
    return mel, segments(mel.mean(axis=1))


def feature_digest(mel: np.ndarray, found: list[tuple[int, int]], tensors: pa.RecordBatch, stream: bytes) -> str:
    """Short text of a clip's features: frames, segments, frames of sound in its tensors, mean mel bands in tenths of a decibel, tensors and CRC-32 of their stream."""
    bands = np.rint(mel.mean(axis=0, dtype=np.float64) * 10).astype(int)
    sound = int(tensors.column("frames").to_numpy().sum())
    return f"{len(mel)}:{len(found)}:{sound}:" + ",".join(map(str, bands.tolist())) + f":{tensors.num_rows}:{crc32(stream):08x}"


def segment_tensors(mel: np.ndarray, found: list[tuple[int, int]], rate: int = RATE) -> pa.RecordBatch:
    """Fixed-shape tensors (TENSOR_FRAMES x MELS) of the segments with their time spans in seconds.

    The last tensor of a segment is filled up with its last frame; ``frames`` tells
    how many are its own.
    """
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
    spans = [(a, min(a + TENSOR_FRAMES, end)) for begin, end in found for a in range(begin, end, TENSOR_FRAMES)]
    data = np.empty((len(spans), TENSOR_FRAMES, MELS), np.float32)
    for k, (a, b) in enumerate(spans):
        data[k] = mel[np.minimum(np.arange(a, a + TENSOR_FRAMES), b - 1)]
    store = pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), TENSOR_FRAMES * MELS)
    hop, size = HOP * DOWN / UP / rate, FRAME * DOWN / UP / rate
    return pa.RecordBatch.from_pydict(
        {
            "tensor": pa.ExtensionArray.from_storage(kind, store),
            "begin_s": pa.array([a * hop for a, _ in spans], pa.float64()),
            "end_s": pa.array([(b - 1) * hop + size for _, b in spans], pa.float64()),
            "frames": pa.array([b - a for a, b in spans], pa.int32()),
        }
    )


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def stored_clip(payload: bytes) -> tuple[bytes, bytes, list[dict], str]:
    """(media, tensors, spans, feature) of a payload, as ``audio_columns`` and ``audio_digests`` both have them."""
    media = to_wav(payload)
    mel, found = clip_features(media)
    tensors = segment_tensors(mel, found)
    stream = to_ipc(tensors)
    spans = [{"begin_s": a, "end_s": b} for a, b in zip(tensors.column("begin_s").to_pylist(), tensors.column("end_s").to_pylist())]
    return media, stream, spans, feature_digest(mel, found, tensors, stream)


def audio_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``media`` (WAV bytes), ``tensors`` (Arrow stream of ``segment_tensors``) and ``spans`` of every row.

    A null or empty text is 576 bytes of 255; repeated rows, and rows with a null id,
    each give a row; other columns are ignored; an empty table gives an empty one.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {"id": batch.column(0), "media": [], "tensors": [], "spans": []}
            for x in batch.column(1):
                media, tensors, spans, _ = stored_clip(payload_of(x.as_py())[0])
                out["media"].append(media)
                out["tensors"].append(tensors)
                out["spans"].append(spans)
            out["spans"] = pa.array(out["spans"], pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())])))
            return out

        return work

    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = by_batch(source, make, f"{ddl(source, 'id')}, media binary, tensors binary, spans array<struct<begin_s:double,end_s:double>>")
    return out.withColumnRenamed("id", id_col)


def audio_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of what ``audio_columns`` stores, with only the digests leaving the worker.

    n_bytes (before padding), payload_bytes, payload_sha256 and tail_crc32 (last 32
    bytes) of the payload as read back from the stored form, media_bytes and
    media_sha256 of that form, and ``feature``, which ends in the number of tensors
    and the CRC-32 of their stream.  Null, empty and repeated rows are as there.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in "abcdefg"}
            for x in batch.column(1):
                payload, n = payload_of(x.as_py())
                media, _, _, feature = stored_clip(payload)
                back = from_wav(media)[0]
                values = (n, len(back), hashlib.sha256(back).hexdigest(), crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for k, v in zip("abcdefg", values):
                    out[k].append(v)
            return {"id": batch.column(0)} | out

        return work

    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = by_batch(source, make, f"{ddl(source, 'id')}, a long, b long, c string, d long, e long, f string, g string")
    return out.toDF(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
