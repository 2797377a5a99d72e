"""Audio features of stored byte streams as fixed-shape Arrow tensors.

A payload is stored as 8-bit PCM in a WAV container, read back from the stored
bytes, and analysed:

* *polyphase resampling* by UP / DOWN (3 / 4): each output phase is its own
  short filter, applied to all its samples at once;
* *overlapped log-mel filterbanks*: Hann frames of 384 samples every 192, power
  spectrum, triangular mel filters, log;
* *hysteresis energy segmentation*: a segment opens where the frame energy
  rises above the high threshold and lasts while it stays above the low one;
  thresholds follow the stream's own energy quantiles;
* each segment's log-mel frames are averaged into a fixed number of time steps,
  so every segment is one tensor of shape (STEPS, MELS) with its time span;
* the segments of a block of documents are stored as one Arrow stream of spans
  and a fixed-shape tensor column, which is read back: descriptions come from
  what was read.

Samples pass in pieces of bounded size with the overlap that filters and frames
need, so a very long stream takes bounded memory beside its own bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import binary, blocks, byte_buffers, ragged, text_rows

RATE = 16_000
UP, DOWN = 3, 4
#: Taps of each phase of the resampling filter.
PHASE_TAPS = 8
FRAME, HOP = 384, 192
MELS, STEPS = 16, 8
PAD_UNIT, PAD_BYTE = 576, 255
#: Streams of more than this, taken together, are analysed one by one.
BATCH_BYTES = 64 << 20
PIECE_FRAMES = 2048


def padded(text: bytes) -> bytes:
    """The text and then bytes 255 up to a positive multiple of 576."""
    size = max(PAD_UNIT, -(-len(text) // PAD_UNIT) * PAD_UNIT)
    return text + bytes([PAD_BYTE]) * (size - len(text))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit unsigned mono PCM: a sample is a byte."""
    n = len(payload)
    if n + 36 >= 1 << 32:
        raise ValueError("a WAV file holds less than 4 GiB")
    odd = b"\0" * (n & 1)
    return (
        b"RIFF" + struct.pack("<I", 36 + n + len(odd)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
        + b"data" + struct.pack("<I", n) + payload + odd
    )


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file of 8-bit mono PCM; any other is an error."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or form[:2] != (1, 1) or form[5] != 8:
                raise ValueError("not 8-bit mono PCM")
            if at + 8 + size > len(media):
                raise ValueError("the WAV file is cut short")
            return media[at + 8 : at + 8 + size], form[2]
        at += 8 + size + (size & 1)
    raise ValueError("the WAV file has no samples")


@cache
def phase_filters() -> np.ndarray:
    """A windowed-sinc low-pass split into its UP phases, oldest tap first:
    (UP, PHASE_TAPS), each phase with unit gain."""
    n = UP * PHASE_TAPS
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    phases = taps.reshape(PHASE_TAPS, UP).T[:, ::-1]
    return (phases / phases.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling of float32 samples, output k from input up to
    k * DOWN // UP.  The first PHASE_TAPS - 1 samples only lead in.

    Taps are added one by one: a sample's value does not depend on what else
    is in the array, so equal streams give equal values in any batch.
    """
    n_out = (len(x) - PHASE_TAPS + 1) * UP // DOWN
    y = np.zeros(max(0, n_out), np.float32)
    for k in range(UP):
        own = y[k::UP]
        for t, tap in enumerate(phase_filters()[k * DOWN % UP]):
            own += tap * x[k * DOWN // UP + t :: DOWN][: len(own)]
    return y


@cache
def mel_filters() -> np.ndarray:
    """Triangular filters, evenly spaced in mel: (FRAME // 2 + 1, MELS)."""
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


@cache
def mel_spans() -> list[tuple[int, int, np.ndarray]]:
    """Of each filter the bins it covers and their weights."""
    found = []
    for column in mel_filters().T:
        used = np.flatnonzero(column)
        found.append((int(used[0]), int(used[-1]) + 1, column[used[0] : used[-1] + 1]))
    return found


@cache
def hann() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype(np.float32)


def spectra(y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and log energies of the frames of ``y`` that begin at
    ``starts``; sums run within a frame, so frames do not affect each other."""
    mel, energy = np.empty((len(starts), MELS), np.float32), np.empty(len(starts), np.float32)
    for a in range(0, len(starts), PIECE_FRAMES):
        frames = y[starts[a : a + PIECE_FRAMES, None] + np.arange(FRAME)]
        f = np.fft.rfft(frames * hann(), axis=1)
        power = f.real**2 + f.imag**2
        for m, (low, high, weights) in enumerate(mel_spans()):
            mel[a : a + PIECE_FRAMES, m] = (power[:, low:high] * weights).sum(1)
        energy[a : a + PIECE_FRAMES] = (frames**2).sum(1)
    return np.log(mel + np.float32(1e-6)), np.log(energy / FRAME + np.float32(1e-9))


def frames_in(n: int) -> int:
    """Frames of a stream of n samples, the last one padded: the first resampled
    value that the last sample reaches is in it."""
    values = -(-(n - 1) * UP // DOWN) + 1
    return max(1, 1 - (FRAME - values) // HOP)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and log energies of all frames of one stream of 8-bit
    samples, in pieces: a very long stream takes little beside its own bytes."""
    n = frames_in(len(samples))
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, PIECE_FRAMES):
        b = min(n, a + PIECE_FRAMES)
        first, last = a * HOP * DOWN // UP, ((b - 1) * HOP + FRAME) * DOWN // UP
        before = samples[max(0, first - PHASE_TAPS + 1) : first]
        x = samples[first:last]
        lead = np.full(PHASE_TAPS - 1 - len(before), samples[0] if len(samples) else 128, np.uint8)
        tail = np.full(last - first - len(x), 128, np.uint8)
        x = (np.concatenate([lead, before, x, tail]).astype(np.float32) - 128) / 128
        mel[a:b], energy[a:b] = spectra(resample(x), np.arange(b - a) * HOP)
    return mel, energy


def log_mels(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``log_mel`` of many streams at once; the same values."""
    if sum(map(len, streams)) > BATCH_BYTES:
        return [log_mel(np.frombuffer(x, np.uint8)) for x in streams]
    lead = -(-(PHASE_TAPS - 1) // DOWN) * DOWN
    parts, starts, counts, at = [bytes([128]) * (PHASE_TAPS - 1)], [], [], 0
    for x in streams:
        counts.append(frames_in(len(x)))
        size = ((counts[-1] - 1) * HOP + FRAME) * DOWN // UP
        parts += [(x[:1] or b"\x80") * lead, x, b"\x80" * (size - len(x))]
        starts.append((at + lead) * UP // DOWN)
        at += lead + size
    y = resample((np.frombuffer(b"".join(parts), np.uint8).astype(np.float32) - 128) / 128)
    count = np.array(counts)
    ends = np.cumsum(count)
    mel, energy = spectra(y, ragged(np.zeros(len(count), np.int64), count) * HOP + np.repeat(starts, count))
    return [(mel[e - n : e], energy[e - n : e]) for e, n in zip(ends.tolist(), counts, strict=True)]


def segments(energy: np.ndarray, high_q: float = 0.6, low_q: float = 0.3) -> np.ndarray:
    """Frame ranges [first, end) that rise above the high threshold and stay
    above the low one; an even stream is one segment."""
    ordered = np.sort(energy)
    high, low = ordered[int(high_q * (len(energy) - 1))], ordered[int(low_q * (len(energy) - 1))]
    if high - low < 1e-4:
        return np.array([[0, len(energy)]])
    on = np.diff((energy >= low).astype(np.int8), prepend=0, append=0)
    runs = np.stack([np.flatnonzero(on == 1), np.flatnonzero(on == -1)], 1)
    rises = np.concatenate([[0], np.cumsum(energy >= high)])
    return runs[rises[runs[:, 1]] > rises[runs[:, 0]]]


def pooled(mel: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """(n, STEPS, MELS): means of each run's frames in STEPS even parts."""
    sums = np.concatenate([np.zeros((1, mel.shape[1])), np.cumsum(mel, 0, dtype=np.float64)])
    size = runs[:, 1] - runs[:, 0]
    k = np.arange(STEPS)
    a = runs[:, :1] + k * size[:, None] // STEPS
    b = np.maximum(runs[:, :1] + (k + 1) * size[:, None] // STEPS, a + 1)
    return ((sums[b] - sums[a]) / (b - a)[:, :, None]).astype(np.float32)


def tensor_batch(starts: np.ndarray, ends: np.ndarray, tensors: np.ndarray) -> pa.RecordBatch:
    """Segments as time spans and fixed-shape tensors."""
    spans = {"start_s": pa.array(starts, pa.float64()), "end_s": pa.array(ends, pa.float64())}
    return pa.RecordBatch.from_pydict(spans | {"log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))})


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    """The segments of a stored tensor column; log_mel keeps its shape."""
    return pa.ipc.open_stream(data).read_all()


def features(media: list[bytes]) -> list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each stored stream the samples read back, start and end seconds of
    its segments, and their tensors."""
    read = [from_wav(x) for x in media]
    found = []
    for (payload, rate), (mel, energy) in zip(read, log_mels([x for x, _ in read]), strict=True):
        runs = segments(energy)
        hop_s = HOP * DOWN / UP / rate
        ends = np.minimum((runs[:, 1] - 1) * hop_s + FRAME * DOWN / UP / rate, len(payload) / rate)
        found.append((payload, runs[:, 0] * hop_s, ends, pooled(mel, runs)))
    return found


def describe(starts: np.ndarray, ends: np.ndarray, tensors: np.ndarray) -> str:
    """Segments, voiced seconds and the mean log-mel spectrum, in fixed decimals."""
    mean = tensors.mean((0, 1), dtype=np.float64)
    return f"{len(starts)};{(ends - starts).sum():.4f};" + ",".join(f"{v:.3f}" for v in mean)


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, spans array<struct<start_s: double, end_s: double>>"
)
LONGS = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")


def stored_tensors(starts: list[np.ndarray], ends: list[np.ndarray], tensors: list[np.ndarray]) -> tuple[pa.ListArray, np.ndarray]:
    """Segments of several streams, stored as one tensor column and read back:
    a list of spans for each stream, and the tensors of all."""
    counts = [len(x) for x in starts]
    batch = tensor_batch(np.concatenate([np.zeros(0), *starts]), np.concatenate([np.zeros(0), *ends]), np.concatenate([np.zeros((0, STEPS, MELS), np.float32), *tensors]))
    read = from_ipc(to_ipc(batch)).combine_chunks()
    spans = pa.StructArray.from_arrays([read[c].combine_chunks() for c in ("start_s", "end_s")], ["start_s", "end_s"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans)
    column = read["log_mel"].combine_chunks()
    return lists, column.to_numpy_ndarray() if len(column) else np.zeros((0, STEPS, MELS), np.float32)


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Stores each whole text as audio, reads it back and describes it.

    Returns the columns of SCHEMA (spans: the time span of each tensor) and,
    with ``keep_media``, media (the stored WAV bytes) and tensors (an Arrow
    stream of start_s, end_s and fixed-shape log_mel; see ``from_ipc``).  Null
    texts are empty texts, which are one unit of padding.  Equal texts give
    equal values, repeated rows one result each, an empty table none; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 4 << 20):
            data, offsets = byte_buffers(block.column(1))
            raw = data.tobytes()
            stored = [to_wav(padded(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            payloads, starts, ends, tensors = zip(*features(stored), strict=True)
            spans, read = stored_tensors(starts, ends, tensors)
            edges = spans.offsets.to_pylist()
            out = {
                "n_bytes": np.diff(offsets).tolist(),
                "payload_bytes": [len(x) for x in payloads],
                "payload_sha256": [hashlib.sha256(x).hexdigest() for x in payloads],
                "tail_crc32": [zlib.crc32(x[-32:]) for x in payloads],
                "media_bytes": [len(x) for x in stored],
                "media_sha256": [hashlib.sha256(x).hexdigest() for x in stored],
                "feature": [describe(s, e, read[a:b]) for s, e, a, b in zip(starts, ends, edges, edges[1:], strict=False)],
            }
            columns = {"doc_id": block.column(0)} | {k: pa.array(v, pa.int64() if k in LONGS else pa.string()) for k, v in out.items()}
            columns["spans"] = spans
            if keep_media:
                own = [to_ipc(tensor_batch(s, e, read[a:b])) for s, e, a, b in zip(starts, ends, edges, edges[1:], strict=False)]
                columns |= {"media": binary(stored), "tensors": binary(own)}
            yield pa.RecordBatch.from_pydict(columns)

    return text_rows(docs, id_col, text_col).mapInArrow(run, SCHEMA + (", media binary, tensors binary" if keep_media else ""))
