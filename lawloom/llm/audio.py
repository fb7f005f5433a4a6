"""Media columns: audio features of 8-bit recordings.

A payload of unsigned 8-bit samples is kept losslessly as a mono WAV file.
From the stored file the samples are read back, resampled by a polyphase FIR
filter (24 kHz to 16 kHz: up 2, down 3), turned into overlapped log-mel frames
(25 ms windows, 10 ms apart) and segmented by energy with hysteresis.  The
log-mel frames are stored in blocks of a fixed shape (frames x bands) as an
Arrow fixed-shape tensor column, each block with its time span.

Every value depends on the bytes of one row only, so equal texts give equal
values however rows are dealt to tasks.  Work and memory per row are linear in
its text; long recordings are filtered in chunks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import arrow_batches, table

UNIT = 192
RATE = 24_000
UP, DOWN = 2, 3
OUT_RATE = RATE * UP // DOWN
WINDOW, HOP, FFT, BANDS = 400, 160, 512, 24
BLOCK = 64
CHUNK = 4096
ENTER_DB, LEAVE_DB = 0.5, -0.5
FLOOR = 1e-6


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded size, and the UTF-8 bytes padded with blanks to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono, unsigned 8-bit PCM file."""
    pad = len(samples) % 2
    head = struct.pack(
        "<4sI4s4sIHHIIHH4sI",
        b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples),
    )
    return head + samples + bytes(pad)


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples; chunks other than ``fmt`` and ``data`` are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _phases(half: int = 6) -> tuple[np.ndarray, int]:
    """Filter taps by output phase, newest sample first reversed for a sliding dot; and the reach before a sample."""
    n = np.arange(-half * DOWN, half * DOWN + 1)
    taps = np.sinc(n / DOWN) * np.hanning(len(n) + 2)[1:-1]
    taps *= UP / taps.sum()
    reach = half * DOWN // UP + 1
    rows = np.zeros((UP, 2 * reach + 1), np.float32)
    for phase in range(UP):
        for j in range(-reach, reach + 1):
            at = phase - j * UP
            if abs(at) <= half * DOWN:
                rows[phase, j + reach] = taps[at + half * DOWN]
    return rows, reach


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` at UP/DOWN times its rate: output m is filter phase ``m*DOWN % UP`` at sample ``m*DOWN // UP``."""
    rows, reach = _phases()
    padded = np.pad(x.astype(np.float32), reach)
    out = np.empty(-(-len(x) * UP // DOWN), np.float32)
    for first in range(UP):
        at = np.arange(first, len(out), UP) * DOWN
        phase, start, step = int(at[0] % UP) if len(at) else 0, int(at[0] // UP) if len(at) else 0, DOWN
        view = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)[start::step][: len(at)]
        for k in range(0, len(at), CHUNK):
            out[first + k * UP : first + (k + len(view[k : k + CHUNK])) * UP : UP] = view[k : k + CHUNK] @ rows[phase]
    return out


@cache
def _mel() -> np.ndarray:
    """Triangular filters over FFT bins, bands equally spaced on the mel scale."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(OUT_RATE / 2), BANDS + 2) / 2595) - 1)
    hz = np.arange(FFT // 2 + 1) * OUT_RATE / FFT
    up = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@cache
def _taper() -> np.ndarray:
    return np.hanning(WINDOW).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n x BANDS) and frame energies in dB; the last frame is padded with silence."""
    n = max(1, -(-max(0, len(x) - WINDOW) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    padded[: len(x)] = x
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    mels, energy = np.empty((n, BANDS), np.float32), np.empty(n, np.float32)
    for k in range(0, n, CHUNK):
        frames = view[k : k + CHUNK] * _taper()
        power = np.abs(np.fft.rfft(frames, FFT, axis=1)).astype(np.float32) ** 2
        # einsum: no BLAS blocking by row count, so a frame's value does not depend on its neighbours
        mels[k : k + CHUNK] = np.log(np.einsum("ij,jk->ik", power, _mel()) + FLOOR)
        energy[k : k + CHUNK] = 10 * np.log10((frames * frames).mean(axis=1) + FLOOR)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Active spans in frames, end exclusive: entered at ENTER_DB from the mean, left below LEAVE_DB."""
    level = energy - energy.mean(dtype=np.float64)
    mark = np.where(level >= ENTER_DB, 1, np.where(level < LEAVE_DB, -1, 0))
    known = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = np.concatenate(([0], (known >= 0) & (mark[known] == 1), [0])).astype(np.int8)
    turns = np.diff(active)
    return list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True))


def _ms(frame: int) -> int:
    return frame * HOP * 1000 // OUT_RATE


def tensor_blocks(mels: np.ndarray, energy: np.ndarray) -> pa.RecordBatch:
    """Blocks of BLOCK frames with their time spans: log-mel and energy as fixed-shape tensor columns; the last block is padded with the floor."""
    n = -(-len(mels) // BLOCK)
    data = np.full((n * BLOCK, BANDS), np.log(np.float32(FLOOR)), np.float32)
    data[: len(mels)] = mels
    level = np.full(n * BLOCK, 10 * np.log10(np.float32(FLOOR)), np.float32)
    level[: len(energy)] = energy
    ends = [min((k + 1) * BLOCK, len(mels)) for k in range(n)]
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray
    return pa.RecordBatch.from_arrays(
        [
            pa.array([_ms(k * BLOCK) for k in range(n)], pa.int64()),
            pa.array(list(map(_ms, ends)), pa.int64()),
            tensor(data.reshape(n, BLOCK, BANDS)),
            tensor(level.reshape(n, BLOCK)),
        ],
        names=["start_ms", "end_ms", "log_mel", "energy_db"],
    )


def write_tensor(batch: pa.RecordBatch) -> bytes:
    """An Arrow IPC stream, which keeps the tensor's shape as a type."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensor(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def frames_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple[int, ...]]:
    """Log-mel frames and energies of a stored tensor without the padding, which the time spans tell; and the tensor's shape."""
    mels = table["log_mel"].combine_chunks().to_numpy_ndarray()
    level = table["energy_db"].combine_chunks().to_numpy_ndarray()
    n = table["end_ms"][-1].as_py() * OUT_RATE // (1000 * HOP)
    return mels.reshape(-1, BANDS)[:n], level.reshape(-1)[:n], mels.shape


def recording(text: str | None, stored: bool) -> dict:
    """All columns of one row; ``stored``: with the media file and the tensor themselves.

    Features and spans come from the tensor as it is read back.
    """
    n_bytes, payload = payload_of(text)
    media = to_wav(payload)
    _, back = from_wav(media)
    samples = np.frombuffer(back, np.uint8)
    tensor = write_tensor(tensor_blocks(*log_mel(resample((samples.astype(np.float32) - 128) / 128))))
    mels, energy, shape = frames_of(read_tensor(tensor))
    spans = [{"start_ms": _ms(a), "end_ms": _ms(b)} for a, b in segments(energy)]
    centre = mels.mean(axis=0, dtype=np.float64)
    row = {
        "n_bytes": n_bytes,
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-16:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"frames={len(mels)};blocks={shape[0]};segments={len(spans)};"
        f"active_ms={sum(s['end_ms'] - s['start_ms'] for s in spans)};energy_db={energy.mean(dtype=np.float64):.3f};"
        f"mel={','.join(f'{v:.2f}' for v in centre)}",
        "tensor_shape": "x".join(map(str, shape)),
        "tensor_sha256": hashlib.sha256(tensor).hexdigest(),
        "spans": spans,
    }
    if stored:
        row |= {"media": media, "tensor": tensor}
    return row


_SPANS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
        ("tensor_shape", pa.string()), ("tensor_sha256", pa.string()), ("spans", _SPANS), ("media", pa.binary()), ("tensor", pa.binary()),
    ]
)
_DIGEST = pa.schema(list(_ARROW)[:-2])
#: Rows given back to Spark at a time when files and tensors are among them.
STORED_ROWS = 64


def media_columns(docs: DataFrame, stored: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the digest columns, the active ``spans`` and, if ``stored``, ``media, tensor``.

    Either way the file and the tensor are made and read back; ``stored`` says
    whether they are returned too.  A null text counts as empty (one unit of
    blanks); a null ``doc_id`` stays null; repeated rows stay repeated and give
    equal values; a very long text is one recording, filtered in chunks; extra
    columns are ignored; an empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    schema = _ARROW if stored else _DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            step = STORED_ROWS if stored else len(ids)
            for at in range(0, len(ids), step or 1):
                texts = batch.column(1).slice(at, step)
                rows = [{"doc_id": i} | recording(x.as_py(), stored) for i, x in zip(ids[at : at + step], texts, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, from_arrow_schema(schema))


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, features and active spans of every document's text as a recording, its tensor stored and read back."""
    return media_columns(table(spark, sf_dir, "documents"), stored=False)
