"""Vectorised 64-bit hashes of words, shingles and byte windows.

Bytes pass through a table of random odd numbers and a polynomial modulo 2^64,
so the hash of any span comes from two prefix sums.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Powers kept; longer texts are hashed in parts that share them.
SPAN = 1 << 20


@cache
def byte_table() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^k and BASE^-k for k up to SPAN."""
    up, down = np.full(SPAN + 1, BASE), np.full(SPAN + 1, INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for spans in rising order of start that do not
    nest; equal bytes give equal hashes wherever they stand."""
    up, down = powers()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        stop = int(np.searchsorted(ends, first + SPAN, "right"))
        if stop <= at:  # a span longer than SPAN, alone: hash its parts one after another
            h = np.uint64(0)
            for a in range(first, int(ends[at]), SPAN):
                part = byte_table()[data[a : min(a + SPAN, int(ends[at]))]]
                h = mix(np.array([h + (part * up[: len(part)]).sum(dtype=np.uint64)]))[0]
            out[at] = h
            at += 1
            continue
        last = int(ends[stop - 1])
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(byte_table()[data[first:last]] * up[: last - first], out=sums[1:])
        a, b = starts[at:stop] - first, ends[at:stop] - first
        out[at:stop] = (sums[b] - sums[a]) * down[a]
        at = stop
    return mix(out + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (between ASCII white space and ends of texts),
    and words a text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    cuts = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(cuts)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and words a text."""
    starts, ends, counts = word_spans(data, offsets)
    return span_hashes(data, starts, ends), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words inside each text, and shingles a text.
    A text of fewer words, but at least one, is one shingle of all its words."""
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    cuts = np.concatenate([[0], np.cumsum(counts)])
    which = np.repeat(np.arange(len(counts)), out_counts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(out_counts) - out_counts, out_counts)
    first = cuts[which] + place
    h = np.zeros(len(which), np.uint64)
    used = np.minimum(counts, size)[which]
    for k in range(size):
        has = used > k
        if has.all():
            h = mix(h + words[first + k])
        else:
            h[has] = mix(h[has] + words[first[has] + k])
    return h, out_counts
