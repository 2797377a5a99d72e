"""Awkward tables for every operator: clashing columns, repeats, nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxloom.llm import audio, bytebpe, licences, lines, neardup, packing, quality, suffixdedup

LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, "some plain text here today", "s"), (1, "some plain text here today", "s"), (2, None, None), (3, "", "s"), (4, " \n\t ", "t"), (None, "x", "t"), (5, LONG, "t"), (6, LONG, "t")]
CLASH = ("block", "bucket", "row", "a", "b", "n", "x", "label", "digest", "weights", "band_key", "shard", "mixed", "ids", "key", "host", "line", "__id", "score")
OPERATORS = {
    "quality": lambda d: quality.quality_scores(d, d.selectExpr("doc_id", "1 as quality")),
    "packing": lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "neardup": neardup.near_duplicate_classes,
    "audio": lambda d: audio.audio_features(d, keep_media=False),
    "licences": licences.scan_licences,
    "bytebpe": lambda d: bytebpe.encode_decode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False),
    "lines": lambda d: lines.drop_boilerplate(d, F.col("source")).drop("row"),
    "suffixdedup": lambda d: suffixdedup.cut_repeats(d, keep_text=False),
}


def texts(frame):
    return sorted(str(tuple(r)) for r in frame.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    clash = frame.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    plain = OPERATORS[name](frame)
    if name == "packing":  # sequences are numbered freely
        plain, other = plain.drop("sequence_id", "offset"), OPERATORS[name](clash).drop("sequence_id", "offset")
    else:
        other = OPERATORS[name](clash)
    assert texts(plain) == texts(other)
    if name != "packing":
        assert len(texts(plain)) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
