"""Byte-level BPE against the library and as an exact round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import bytebpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ENCODING = bytebpe.load_encoding(PATH, PATTERN)
ODD = ["", " ", "  ", "a  b   c \n \n d\t\te  ", "   b 　　 c", "it's 'so ", "\n\n\n a", "a \x1c b\x1c\x1c c", "é" * 50, "x" * 5000, "😀 ‍"]


@given(st.text(alphabet=st.sampled_from(" \n\t  ab'sé1.😀\x1c"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_exploding_gives_the_pre_tokens(text):
    import pyarrow as pa
    import regex

    words, index, counts = bytebpe.explode(pa.array([text, "a b", text]), regex.compile(PATTERN))
    found = [words[k] for k in index]
    assert found[: counts[0]] == found[len(found) - counts[2] :] == regex.findall(PATTERN, text)


def test_ids_and_round_trip(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(99, None), (None, "x"), (5, ODD[5])]
    found = bytebpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for row in found:
        text = texts[row["doc_id"]] or ""
        ids = ENCODING.encode_ordinary(text)
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert bytes(row["decoded"]) == text.encode()
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_documents(spark, sf_dir):
    from voxloom.llm.catalogue import op8_byte_bpe

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op8_byte_bpe(spark, sf_dir).collect()
    assert {r["doc_id"] for r in found} == set(docs) and len(found) == len(docs)
    for row in found:
        ids = ENCODING.encode_ordinary(docs[row["doc_id"]])
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(docs[row["doc_id"]].encode()).hexdigest()


def test_decode(spark):
    ids = spark.createDataFrame([(1, ENCODING.encode_ordinary("héllo wörld")), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r[0]: bytes(r[1]) for r in bytebpe.decode(ids, PATH).collect()} == {1: "héllo wörld".encode(), 2: b"", 3: b""}
    with pytest.raises(Exception, match="token-byte table"):
        bytebpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), PATH).collect()
    assert bytebpe.token_table(spark, PATH).count() == len(bytebpe.load_ranks(PATH))


def test_many_blocks_share_words(spark, monkeypatch):
    """Blocks of a few bytes, so that every word crosses the shuffle."""
    rows = [(k, f"the word{k % 7} the") for k in range(200)]
    monkeypatch.setattr(bytebpe, "EXPLODE_BYTES", 64)
    found = bytebpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, PATTERN).collect()
    texts = dict(rows)
    assert all(r["ids"] == ENCODING.encode_ordinary(texts[r["doc_id"]]) for r in found) and len(found) == 200
