"""The thin queries over the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every 50th embedding by integer inner product."""
    from voxloom.llm.kdsearch import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named in every document."""
    from voxloom.llm.licences import scan_licences

    rows = scan_licences(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_paragraphs", "n_licence", "families", F.to_json("found").alias("found"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    from voxloom.llm.bytebpe import encode_decode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    from voxloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    from voxloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the WARC files of all pages, both as bytes that were
    written and are parsed: in the replica one byte of every 97th page's record
    is another, and every 389th page's record is gone."""
    from voxloom.llm.common import passing_tables, release_shuffles, written
    from voxloom.llm.warc import audit_files, damaged, page_records, warc_files

    with passing_tables(spark):
        files = written(warc_files(page_records(table(spark, sf_dir, "pages"))), "warc", "zstd")
        release_shuffles(spark)
        replica = written(damaged(files, lambda page_id: page_id % 389 == 7, lambda page_id: page_id % 97 == 13), "replica", "zstd")
        return audit_files(files, replica)


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS file_no,
         strlen(concat('WARC/1.0', 'RN', 'WARC-Type: response', 'RN', 'WARC-Record-ID: <urn:page:', page_id, '>', 'RN',
                       'WARC-Date: 2024-01-01T00:00:00Z', 'RN', 'WARC-Target-URI: ', coalesce(url, ''), 'RN',
                       'Content-Type: text/html', 'RN', 'Content-Length: ', strlen(coalesce(html, '')), 'RNRN'))
         + strlen(coalesce(html, '')) + 4 AS n
  FROM pages
), r AS (
  SELECT page_id, file_no, n, row_number() OVER w - 1 AS record_no, CAST(sum(n) OVER w AS BIGINT) AS "end"
  FROM p WINDOW w AS (PARTITION BY file_no ORDER BY page_id ROWS UNBOUNDED PRECEDING)
)
SELECT page_id, file_no, CAST(record_no AS BIGINT) AS record_no, CAST("end" - n AS BIGINT) AS start, "end",
       CASE WHEN page_id % 389 = 7 THEN 'missing' ELSE 'corrupt' END AS status
FROM r WHERE page_id % 389 = 7 OR page_id % 97 = 13
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from voxloom.llm.neardup import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as audio, read back and described."""
    from voxloom.llm.audio import audio_features

    return audio_features(table(spark, sf_dir, "documents"), keep_media=False)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    from voxloom.llm.lines import drop_boilerplate

    rows = drop_boilerplate(table(spark, sf_dir, "documents"), F.col("source"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.col("kept").alias("text"))


OP9_SQL = """
WITH p AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
l AS (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM p),
b AS (
  SELECT l.source, l.line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.line <> '' GROUP BY l.source, l.line, t.pages
  HAVING count(*) >= 5 AND count(*) > CAST(0.05 AS DOUBLE) * t.pages
),
s AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
k AS (
  SELECT p.doc_id, p.lines,
         list_filter(p.lines, lambda x: s.bad IS NULL OR NOT list_contains(s.bad, trim(x, ' '))) AS stays
  FROM p LEFT JOIN s ON p.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(stays), 0) AS BIGINT) AS n_dropped,
       CASE WHEN lines IS NULL THEN NULL ELSE coalesce(array_to_string(stays, chr(10)), '') END AS text
FROM k
"""


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without strings of 100 bytes that also start earlier."""
    from voxloom.llm.suffixdedup import cut_repeats

    return cut_repeats(table(spark, sf_dir, "documents"), 100, keep_text=False)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality, op2_packing, op3_warc_audit, op4_near_duplicates, op5_audio, op6_top_k, op7_licences, op8_byte_bpe, op9_lines, op10_suffix_array)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_audit": OP3_SQL, "op6_top_k": OP6_SQL, "op9_lines": OP9_SQL}
