"""Audio features take the last stored bytes."""

import numpy as np
import pytest

from voxloom.llm import audio


@pytest.mark.parametrize("units", range(1, 9))
def test_every_stored_byte_is_in_a_frame(units):
    n = units * audio.PAD_UNIT
    stream = np.random.default_rng(units).integers(0, 256, n).astype(np.uint8)
    whole = audio.log_mel(stream)[1]
    for back in (1, 2, 3, 4, 63, 64, 65, 128, 192, 193, n):
        other = stream.copy()
        other[-back] ^= 128
        assert not np.array_equal(audio.log_mel(other)[1], whole), back
    last = (audio.frames_in(n) - 1) * audio.HOP * audio.DOWN // audio.UP
    assert last < n <= last + audio.FRAME * audio.DOWN // audio.UP


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 514, 767, 768, 769, 1021, 2304, 2305])
def test_ends_are_equal_in_any_batch(n):
    stream = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    alone, together = audio.log_mel(stream), audio.log_mels([b"x" * 700, stream.tobytes(), b"yz"])[1]
    assert np.array_equal(alone[0], together[0]) and np.array_equal(alone[1], together[1])


def test_texts_that_differ_at_the_end_have_other_features():
    one, two = b"ab" * 576, b"ab" * 544 + b"XY" * 32
    described = [audio.describe(*audio.features([audio.to_wav(audio.padded(x))])[0][1:]) for x in (one, two)]
    assert described[0] != described[1]
