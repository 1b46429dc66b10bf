"""Operator 5, audio columns: log-mel features of stored 8-bit samples.

A payload is stored as a RIFF/WAVE file of unsigned 8-bit mono samples, which
are its bytes, in a binary column.  Features are computed from what is read
back: a polyphase filter resamples 16 to 12 kHz, overlapped Hann frames go
through a mel filterbank, and frames are grouped to segments by the hysteresis
of their energy: a segment begins above the upper threshold and lasts while
frames stay above the lower one.

Frames are stored as fixed-shape Arrow tensors of 16-bit floats (``PATCH``
frames by ``MELS`` bands, the last patch padded with the floor), one Arrow
stream per recording with the time span of each patch, in a binary column of
the features' table, which is read back.  A task
holds one recording at a time as a whole, with its samples as 32-bit floats,
its resampled signal and its frames: about 10 bytes for a byte of text, and the
spectra of 1024 frames.

A null text is an empty one; its payload is one unit of padding.  Equal texts
have equal values, since nothing depends on other rows.  Repeated rows give
repeated results; an empty table gives an empty one; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import tokens
from loomgrid.llm.shared import Workspace

#: Payload lengths are multiples of this (fixed by the contract).
UNIT, PAD = 576, 255
RATE, UP, DOWN = 16_000, 3, 4
TARGET = RATE * UP // DOWN
TAPS = 8  # per phase
FRAME, HOP, MELS, PATCH = 360, 180, 40, 96  # 30 ms frames, 15 ms apart
FLOOR = 1e-8
#: Energies (mean log-mel) at which a segment begins, and below which it ends.
UPPER, LOWER = -1.1, -1.45
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes before padding."""
    raw = (text or "").encode()
    units = max(1, -(-len(raw) // UNIT))
    return raw + bytes([PAD]) * (units * UNIT - len(raw)), len(raw)


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A mono file of unsigned 8-bit samples; chunks have even lengths."""
    odd = len(payload) & 1
    head = HEADER.pack(b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def from_wave(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a mono file of unsigned 8-bit samples."""
    riff, _, wave, fmt, _, codec, channels, rate, _, _, bits, data, size = HEADER.unpack_from(media)
    if (riff, wave, fmt, codec, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data"):
        raise ValueError("not a mono file of 8-bit samples")
    return media[HEADER.size : HEADER.size + size], rate


@lru_cache(1)
def _filter() -> np.ndarray:
    """Phases (UP, 2 * TAPS) of a windowed-sinc low-pass at the lower of both band limits."""
    n = 2 * TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = cut * np.sinc(t * cut) * np.kaiser(n, 6.0) * UP
    return h.reshape(2 * TAPS, UP).T[:, ::-1].copy()


@lru_cache(1)
def _mel() -> np.ndarray:
    """Triangular filterbank (FRAME // 2 + 1, MELS)."""
    scale = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(scale(20.0), scale(TARGET / 2), MELS + 2) / 2595) - 1)
    freqs = np.fft.rfftfreq(FRAME, 1 / TARGET)
    up = (freqs[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - freqs[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """16 to 12 kHz: output i is phase (i * DOWN) % UP at input (i * DOWN) // UP."""
    n = len(samples) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), samples, np.zeros(TAPS + DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * TAPS)
    out = np.empty(n, np.float32)
    phases = _filter().astype(np.float32)
    for k in range(UP):  # outputs k, k + UP, ... start at inputs (k * DOWN) // UP + j * DOWN
        rows = windows[(k * DOWN) // UP :: DOWN][: len(range(k, n, UP))]
        out[k::UP] = rows @ phases[(k * DOWN) % UP]
    return out


def log_mel(signal: np.ndarray) -> np.ndarray:
    """(frames, MELS) log10 mel energies; a signal shorter than a frame is one padded frame."""
    n = max(1, -(-(len(signal) - FRAME) // HOP) + 1)
    signal = np.concatenate([signal, np.zeros((n - 1) * HOP + FRAME - len(signal), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    window, bank, out = np.hanning(FRAME).astype(np.float32), _mel(), np.empty((n, MELS), np.float32)
    for at in range(0, n, 1024):
        spectrum = np.fft.rfft(frames[at : at + 1024] * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[at : at + 1024] = np.log10((power @ bank) / FRAME + FLOOR)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [begin, end) by hysteresis."""
    loud, state = np.flatnonzero((energy >= UPPER) | (energy < LOWER)), np.zeros(len(energy), bool)
    if len(loud):
        last = np.zeros(len(energy), np.int64)
        last[loud] = np.arange(1, len(loud) + 1)
        last = np.maximum.accumulate(last)
        state = (last > 0) & (energy[loud[np.maximum(last, 1) - 1]] >= UPPER)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], state, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def features(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and loud segments of a stored recording."""
    samples, _ = from_wave(media)
    signal = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(signal))
    return mel, segments(mel.mean(axis=1))


def tensors(mel: np.ndarray):
    """Arrow record batch: patches as fixed-shape tensors with their time spans in milliseconds."""
    import pyarrow as pa

    patches = -(-len(mel) // PATCH)
    padded = np.full((patches * PATCH, MELS), np.log10(FLOOR), np.float32)
    padded[: len(mel)] = mel
    starts = np.arange(patches) * PATCH
    ends = np.minimum(starts + PATCH, len(mel))
    ms = 1000 * HOP / TARGET
    return pa.RecordBatch.from_arrays(
        [
            pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(patches, PATCH, MELS).astype(np.float16)),
            pa.array(np.rint(starts * ms), pa.int64()),
            pa.array(np.rint((ends - 1) * ms + 1000 * FRAME / TARGET), pa.int64()),
        ],
        names=["log_mel", "start_ms", "end_ms"],
    )


def tensor_stream(mel: np.ndarray) -> bytes:
    """The tensors of one recording as an Arrow stream, for a binary column."""
    import pyarrow as pa

    batch, sink = tensors(mel), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def digest(mel: np.ndarray, loud: list[tuple[int, int]]) -> str:
    """Frames, segments, loud frames, and mean and extremes of the energies in hundredths."""
    energy = mel.mean(axis=1)
    hundredths = [int(np.floor(100 * float(x) + 0.5)) for x in (energy.mean(dtype=np.float64), energy.min(), energy.max())]
    bands = ",".join(str(int(np.floor(10 * x + 0.5))) for x in mel.mean(axis=0, dtype=np.float64)[:: MELS // 8])
    return f"frames={len(mel)};segments={len(loud)};loud={sum(e - b for b, e in loud)};energy={hundredths[0]},{hundredths[1]},{hundredths[2]};bands={bands}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text's payload as a stored recording."""
    import pyarrow as pa

    def run(batches):
        for rows in tokens.slices(tokens.batch_rows(batches)):
            made = [payload_of(t) for _, t in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([to_wave(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def analyse(stored: DataFrame, with_tensors: bool = True) -> DataFrame:
    """Checksums and features of recordings (doc_id, n_bytes, media) as they are read back."""
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    fields += [("segments_ms", pa.list_(pa.list_(pa.int64()))), ("tensors", pa.binary())] if with_tensors else []

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for doc_id, n_bytes, media in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns], strict=True):
                    payload, _ = from_wave(media)
                    mel, loud = features(media)
                    row = [doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), digest(mel, loud)]
                    if with_tensors:
                        row += [[[b * 1000 * HOP // TARGET, ((e - 1) * HOP + FRAME) * 1000 // TARGET] for b, e in loud], tensor_stream(mel)]
                    out.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out), fields, strict=True)], names=[n for n, _ in fields])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + (", segments_ms array<array<long>>, tensors binary" if with_tensors else ""))


def store_and_analyse(spark: SparkSession, docs: DataFrame, with_tensors: bool = True) -> DataFrame:
    """Write all recordings as a media table, and the features of what is read back as another one, which is the result."""
    space = Workspace(spark, "audio")
    made = space.table(analyse(space.table(store(docs), "media"), with_tensors), "features")
    space.drop("media")
    return made


def tensors_of(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(patches, (start, end) in milliseconds) of one recording's stored tensors."""
    import pyarrow as pa

    table = pa.ipc.open_stream(stream).read_all().combine_chunks()
    patches = table["log_mel"].combine_chunks().to_numpy_ndarray()
    return patches, np.stack([table[c].to_numpy() for c in ("start_ms", "end_ms")], axis=1)
