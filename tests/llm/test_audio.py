"""Audio features: lossless storage, the same values in any batch, tensors."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from voxloom.llm import audio


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 1152, 70001])
def test_payload_round_trip(n):
    text = bytes(np.random.default_rng(n).integers(0, 256, n, np.uint8))
    payload = audio.padded(text)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload[:n] == text and set(payload[n:]) <= {255}
    media = audio.to_wav(payload)
    assert audio.from_wav(media) == (payload, audio.RATE)
    import io
    import wave

    with wave.open(io.BytesIO(media)) as read:
        assert read.getsampwidth() == 1 and read.readframes(1 << 30) == payload


def test_damaged_media():
    good = audio.to_wav(b"\x80" * 576)
    for bad in (b"", good[:100], b"RIFX" + good[4:], good[:22] + b"\x02" + good[23:], good[:36]):
        with pytest.raises(ValueError):
            audio.from_wav(bad)


def test_equal_in_any_batch():
    rng = np.random.default_rng(3)
    streams = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (576, 3, 0, 5000, 576 * 9, 1 << 16)]
    together = audio.log_mels(streams)
    for stream, (mel, energy) in zip(streams, together, strict=True):
        for other in (audio.log_mel(np.frombuffer(stream, np.uint8)), audio.log_mels([stream, stream])[1]):
            assert np.array_equal(mel, other[0]) and np.array_equal(energy, other[1])


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / audio.RATE
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8)
    padded = np.concatenate([np.full(audio.PHASE_TAPS - 1, tone[0]), tone])
    y = audio.resample((padded.astype(np.float32) - 128) / 128)
    assert len(y) == 12_000
    peak = np.argmax(np.abs(np.fft.rfft(y))) * 12_000 / len(y)
    assert abs(peak - 1000) < 2
    mel, _ = audio.log_mel(tone)
    assert np.argmax(mel.mean(0)) == np.argmax(audio.mel_filters()[round(1000 / (12_000 / audio.FRAME))])


def test_hysteresis():
    energy = np.array([0, 0, 5, 3, 5, 0, 3, 3, 0, 6, 0], float)
    runs = audio.segments(energy, high_q=0.8, low_q=0.5)
    assert runs.tolist() == [[2, 5], [9, 10]]  # 6 to 8 never rises above the high threshold
    assert audio.segments(np.zeros(4)).tolist() == [[0, 4]]


def test_tensors(spark):
    rows = [(1, "ab" * 3000), (2, None), (3, ""), (4, "ab" * 3000)]
    found = {r["doc_id"]: r for r in audio.audio_features(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        row, payload = found[doc_id], audio.padded((text or "").encode())
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-32:])
        assert row["media_sha256"] == hashlib.sha256(row["media"]).hexdigest() and row["media_bytes"] == len(row["media"])
        assert audio.from_wav(bytes(row["media"]))[0] == payload and row["n_bytes"] == len((text or "").encode())
        table = audio.from_ipc(bytes(row["tensors"]))
        assert isinstance(table.schema.field("log_mel").type, pa.FixedShapeTensorType)
        assert table["log_mel"].combine_chunks().to_numpy_ndarray().shape[1:] == (audio.STEPS, audio.MELS)
        assert all(a < b <= len(payload) / audio.RATE + 1e-9 for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))
    assert found[1]["feature"] == found[4]["feature"] and found[2]["feature"] == found[3]["feature"] != found[1]["feature"]
