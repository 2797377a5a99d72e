"""Packing: exact ids, gapless sequences, and how full they are."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = packing.WordTokenizer(PATH)


def full_ids(text):
    return WORDS.full.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("abÉéßİΣσ'st12.!  \n\t \x85\x1c<|>ﬁ́"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_librarys(text):
    ids, counts = WORDS.texts(pa.array([text, "x", text]))
    assert ids[: counts[0]].tolist() == full_ids(text) == ids[counts[0] + counts[1] :].tolist()


def test_all_characters():
    texts = ["a" + "".join(map(chr, range(k, k + 64))) + "b" for k in range(0, 0x3000, 64)]
    ids, counts = WORDS.texts(pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == full_ids(text)


@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_best_fit(lengths, open_bins):
    bins, places = packing.best_fit(lengths, 50, open_bins)
    free, still, plain = {}, [], []  # the same by linear search
    for need in lengths:
        fits = [b for b in still if free[b] >= need]
        if fits:
            own = min(fits, key=lambda b: free[b])
        else:
            if len(still) == open_bins:
                still.remove(min(still, key=lambda b: free[b]))
            own = len(free)
            free[own] = 50
            still.append(own)
        plain.append(50 - free[own])
        free[own] -= need
        if not free[own]:
            still.remove(own)
    assert len(free) == max(bins, default=-1) + 1 and sorted(plain) == sorted(places)


def test_documents(spark):
    long = "word " * 9000
    rows = [(1, "one two"), (2, None), (3, ""), (4, long), (5, "one two"), (5, "one two"), (None, "x")]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    texts = dict(rows)
    by_sequence = defaultdict(list)
    for row in found:
        ids = np.array([*full_ids(texts[row["doc_id"]] or ""), 1], "<u4")
        part = ids[row["start"] : row["start"] + row["length"]]
        assert row["start"] == 4096 * row["piece"] and row["length"] == len(part)
        assert row["ids_crc32"] == zlib.crc32(part.tobytes())
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    assert sum(r["doc_id"] == 4 for r in found) == 3
    assert sum(r["doc_id"] == 5 for r in found) == 2


def test_sequences_are_full(spark):
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.0, 20_000).astype(int) + 1)
    pieces = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    used = packing.pack(pieces).select("sequence_id").distinct().count()
    assert used <= 1.004 * lengths.sum() / 4096 + 1
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(pieces.limit(1).selectExpr("doc_id", "piece", "start", "5000L as length", "ids_crc32")).collect()
