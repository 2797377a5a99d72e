"""Audio features against their definitions, written out plainly."""

import numpy as np
import pytest

from voxloom.llm import audio


def plain_resample(x):
    """Zeros between samples, one low-pass over all, every DOWN-th value."""
    n = audio.UP * audio.PHASE_TAPS
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / max(audio.UP, audio.DOWN)) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    for phase in range(audio.UP):  # each phase passes a constant unchanged
        taps[phase :: audio.UP] /= taps[phase :: audio.UP].sum()
    wide = np.zeros(len(x) * audio.UP)
    wide[:: audio.UP] = x
    return np.convolve(wide, taps)[: len(wide) : audio.DOWN]


def plain_frames(samples):
    lead = np.full(4 * audio.PHASE_TAPS, samples[0])
    n = audio.frames_in(len(samples))
    tail = np.full(n * audio.HOP * 2 + audio.FRAME * 2, 128)
    y = plain_resample((np.concatenate([lead, samples, tail]).astype(float) - 128) / 128)[len(lead) * audio.UP // audio.DOWN :]
    return [y[k * audio.HOP : k * audio.HOP + audio.FRAME] for k in range(n)]


def plain_log_mel(frame):
    n = audio.FRAME
    windowed = frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n))
    k, t = np.arange(n // 2 + 1)[:, None], np.arange(n)[None]
    power = np.abs((windowed * np.exp(-2j * np.pi * k * t / n)).sum(1)) ** 2
    rate = audio.RATE * audio.UP / audio.DOWN
    to_mel, to_hz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = to_hz(np.linspace(0, to_mel(rate / 2), audio.MELS + 2))
    out = []
    for low, mid, high in zip(edges, edges[1:], edges[2:], strict=False):
        weights = [max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) for f in np.arange(n // 2 + 1) * rate / n]
        out.append(np.log(power @ weights + 1e-6))
    return out


def plain_segments(energy):
    ordered = sorted(energy)
    high, low = ordered[int(0.6 * (len(energy) - 1))], ordered[int(0.3 * (len(energy) - 1))]
    if high - low < 1e-4:
        return [(0, len(energy))]
    found, begin, rose = [], None, False
    for k, e in enumerate([*energy, -np.inf]):
        if e >= low:
            begin, rose = k if begin is None else begin, rose or e >= high
        elif begin is not None:
            if rose:
                found.append((begin, k))
            begin, rose = None, False
    return found


@pytest.mark.parametrize("n", [576, 1152, 5760])
def test_log_mel_and_energy(n):
    samples = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    mel, energy = audio.log_mel(samples)
    frames = plain_frames(samples)
    assert len(frames) == len(mel)
    assert np.allclose(mel, [plain_log_mel(f) for f in frames], atol=2e-3)
    assert np.allclose(energy, [np.log((f**2).mean() + 1e-9) for f in frames], atol=1e-4)


@pytest.mark.parametrize("seed", range(20))
def test_segments(seed):
    energy = np.round(np.random.default_rng(seed).normal(size=40), 1).astype(np.float32)
    assert list(map(tuple, audio.segments(energy).tolist())) == plain_segments(energy.tolist())


def test_pooling():
    mel = np.random.default_rng(1).normal(size=(30, audio.MELS)).astype(np.float32)
    for a, b in ((0, 30), (3, 20), (5, 7), (29, 30)):
        parts = [mel[a + k * (b - a) // audio.STEPS : max(a + (k + 1) * (b - a) // audio.STEPS, a + k * (b - a) // audio.STEPS + 1)].mean(0) for k in range(audio.STEPS)]
        assert np.allclose(audio.pooled(mel, np.array([[a, b]]))[0], parts, atol=1e-5)


def test_the_query_describes_stored_tensors(spark):
    rows = [(1, "abc " * 2000), (2, None), (3, "x" * 40_000 + "y z " * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    thin = {r["doc_id"]: r for r in audio.audio_features(frame, keep_media=False).collect()}
    for row in audio.audio_features(frame).collect():
        table = audio.from_ipc(bytes(row["tensors"]))
        tensors = table["log_mel"].combine_chunks().to_numpy_ndarray()
        spans = list(zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))
        assert [tuple(s) for s in thin[row["doc_id"]]["spans"]] == spans
        n, voiced, spectrum = thin[row["doc_id"]]["feature"].split(";")
        assert int(n) == len(tensors) and float(voiced) == pytest.approx(sum(e - s for s, e in spans), abs=1e-4)
        assert np.allclose([float(v) for v in spectrum.split(",")], tensors.mean((0, 1)), atol=1e-3)
