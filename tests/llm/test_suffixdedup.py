"""Substring dedup against brute force; suffix sorting against sorting."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import catalogue, suffixdedup


def brute(rows, length=100):
    first, out = {}, []
    place = lambda i: -(1 << 70) if i is None else i
    for doc_id, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            window, at = data[k : k + length], (place(doc_id), k)
            first[window] = min(first.get(window, at), at)
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < (place(doc_id), k):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(doc_id), len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cut(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixdedup.cut_repeats(frame, keep_text=False, **options).collect()
    return sorted((str(r[0]), *r[1:]) for r in found)


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 60))
@settings(max_examples=300, deadline=None)
def test_suffix_order(values, needed):
    s = np.array(values)
    order = suffixdedup.suffix_ranks(s, 1, needed).tolist()
    prefixes = [values[k : k + needed] for k in order]
    assert sorted(order) == list(range(len(values))) and prefixes == sorted(prefixes)


def test_full_suffix_order():
    rng = np.random.default_rng(0)
    for n, a in ((300, 1), (300, 2), (1000, 4), (1000, 250)):
        values = rng.integers(1, a + 1, n).tolist()
        assert suffixdedup.suffix_ranks(np.array(values), 1, 1 << 40).tolist() == sorted(range(n), key=lambda k: values[k:])


def test_edges(spark):
    rng = np.random.default_rng(5)
    prose = "".join(rng.choice(list("abcdefgh "), 900))
    rows = [
        (1, prose), (2, prose[100:400] + "zz" + prose[50:260]), (3, prose[:99]), (4, None), (5, ""), (6, "a" * 400 + "b" * 300), (7, "xyz" * 200 + "a" * 150),
        (8, prose), (8, prose), (None, prose[300:600]), (-7, prose[600:] * 2), (9, "éü" * 300), (10, prose[:100]), (11, prose[1:100] + "?"),
    ]
    assert cut(spark, rows) == brute(rows)
    assert cut(spark, [(9, "éü" * 300), (10, "q" * 40)], length=40) == brute([(9, "éü" * 300), (10, "q" * 40)], 40)
    assert suffixdedup.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        suffixdedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20)


def test_long_texts_and_small_sorts(spark, monkeypatch):
    """Texts beyond a hashing chunk, and buckets sorted in many parts."""
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", 512)
    monkeypatch.setattr(suffixdedup, "SORT_BYTES", 300)
    rng = np.random.default_rng(6)
    prose = "".join(rng.choice(list("abcd "), 3000))
    rows = [(1, prose), (2, prose[500:1700] + prose[300:900]), (3, prose[::-1]), (4, prose[::-1][700:1900])]
    assert cut(spark, rows) == brute(rows)


def test_hot_anchors_travel_alone(spark, monkeypatch):
    """Every repeated anchor counts as hot; a passage that all documents share."""
    monkeypatch.setattr(suffixdedup, "HOT_ANCHOR", 1)
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(250)
    rows = [(k, word(80) + passage + word(80) + passage[: 90 + k]) for k in range(30)] + [(99, "r" * 300), (100, "r" * 250)]
    assert cut(spark, rows) == brute(rows)


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((str(r[0]), *r[1:]) for r in catalogue.op10_suffix_array(spark, sf_dir).collect())
    assert found == brute(rows)


def test_kept_text_and_spans(spark):
    passage = "the same hundred bytes " * 6
    frame = spark.createDataFrame([(1, "One. " + passage, "x"), (2, "Zwölf " + passage + " end", "y"), (None, "z", "z")], "doc_id long, text string, block string")
    row = suffixdedup.cut_repeats(frame).filter("doc_id = 2").first()
    text = frame.filter("doc_id = 2").first()["text"].encode()
    gone = b"".join(text[s["start"] : s["start"] + s["length"]] for s in row["spans"])
    assert len(gone) == row["n_removed"] > 100 and bytes(row["kept"]) + gone != b"" and len(row["kept"]) + len(gone) == len(text)
    kept = {r["doc_id"]: r for r in suffixdedup.without_repeats(frame).collect()}
    assert kept[2]["text"].startswith("Zwölf") and len(kept[2]["text"]) < 60 and kept[None]["text"] == "z" and kept[2]["block"] == "y"
