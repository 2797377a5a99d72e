"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import table, written
from voxloom.llm.lines import drop_boilerplate
from voxloom.llm.neardup import near_duplicate_classes, one_of_each
from voxloom.llm.packing import pack_documents
from voxloom.llm.quality import keep_quality
from voxloom.llm.suffixdedup import without_repeats

#: A document below this score goes: well under the even score of 0.5, so that clean documents stay.
REJECT_BELOW = 0.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), REJECT_BELOW)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source."""
    found = drop_boilerplate(docs, F.col("source"))
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept").cast("long"))
    return found.select(row.alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each near-duplicate class."""
    return one_of_each(docs, near_duplicate_classes(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes that stand earlier in the corpus."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: Classifiers, sampling and tokenisation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
