"""WARC audits: each fault is found where it is, and nothing else."""

import pytest
from pyspark.sql import functions as F

from voxloom.llm import warc

PAGES = "page_id long, url string, html string"


def records(spark, n=50, extra=()):
    return warc.page_records(spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>" * (k % 7)) for k in range(n)] + list(extra), PAGES))


def found(frame):
    return sorted((r["page_id"], r["status"]) for r in frame.collect())


@pytest.mark.parametrize("gone", [0, 25, 49])
def test_one_lost_record_is_one_row(spark, gone):
    whole = records(spark)
    less = whole.filter(F.col("page_id") != gone)
    files = warc.warc_files(whole)
    assert found(warc.audit(whole, less)) == [(gone, "missing")] and found(warc.audit(less, whole)) == [(gone, "extra")]
    assert found(warc.audit_files(files, warc.warc_files(less))) == [(gone, "missing")]
    row = warc.audit_files(files, warc.damaged(files, lambda k: k == gone, lambda k: False)).collect()
    place = warc.ranges(whole).filter(F.col("page_id") == gone).first()
    assert [(r["page_id"], r["record_no"], r["start"], r["end"], r["status"]) for r in row] == [(gone, place["at"], place["start"], place["end"], "missing")]


def test_replicas_that_agree_end_at_the_roots(spark, monkeypatch):
    def never(*_):
        raise AssertionError("looked below the roots")

    monkeypatch.setattr(warc, "below", never)
    files = warc.warc_files(records(spark))
    assert warc.audit_files(files, files).collect() == []
    with pytest.raises(AssertionError):
        warc.audit(records(spark), records(spark, 49))


@pytest.mark.parametrize("cut", [(0, 1), (5, 60), (100, 101), (2000, 2300)])
def test_damaged_bytes(spark, cut):
    """Bytes cut out of a file, headers too: only records that they touch."""
    a, b = cut
    files = warc.warc_files(records(spark))
    wrong = files.withColumn("content", F.concat(F.substring("content", 1, a), F.expr(f"substring(content, {b + 1})")))
    touched = {r["page_id"] for r in warc.ranges(records(spark)).collect() if r["start"] < b and a < r["end"]}
    assert {p for p, _ in found(warc.audit_files(files, wrong))} == touched


def test_scan_finds_what_parse_finds():
    body = b"".join(b"WARC/1.0\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (k, 3 * k, b"a\r\n" * k) for k in range(5))
    assert [(a, b - a, k) for a, b, k in warc.scan_warc(body)] == [(a, n, k) for k, (a, n, _, _) in enumerate(warc.parse_warc(body))]
    assert list(warc.scan_warc(b"")) == [] and list(warc.scan_warc(b"junk")) == [(0, 4, None)]


def test_large_files_are_laid_out_in_volumes(spark, monkeypatch):
    monkeypatch.setattr(warc, "VOLUME_BYTES", 1000)
    whole = records(spark)
    files = warc.warc_files(whole)
    assert files.count() > 5
    index = sorted(map(tuple, warc.indexed(files).collect()))
    assert index == sorted(map(tuple, warc.ranges(whole).select("page_id", "file_no", "at", "start", "end", "hash").collect()))
    assert found(warc.audit_files(files, warc.damaged(files, lambda k: k == 30, lambda k: k % 20 == 3))) == [(3, "corrupt"), (23, "corrupt"), (30, "missing"), (43, "corrupt")]


def test_nulls_repeats_and_clashing_columns(spark):
    extra = [(None, "u", "x"), (None, "u", "x"), (None, None, None), (7, "again", "x"), (7, "again", "x"), (2500, "far", None), (3, None, "")]
    whole = records(spark, extra=extra)
    clash = whole.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("at", "n", "hash", "place", "side", "start", "end", "volume", "up"))])
    assert found(warc.audit(whole, clash.drop("n").withColumn("n", F.lit(0)))) == []
    one = spark.createDataFrame([(7, "again", "x")], PAGES)
    less = whole.exceptAll(warc.page_records(one))
    assert found(warc.audit(whole, less)) == [(7, "missing")]
    nameless = whole.exceptAll(warc.page_records(spark.createDataFrame([(None, "u", "x")], PAGES)))
    assert found(warc.audit(whole, nameless)) == [(-1, "missing")]
    empty = whole.filter("false")
    assert len(found(warc.audit(whole, empty))) == whole.count() and found(warc.audit(empty, empty)) == []
    assert found(warc.audit(whole, whole.withColumn("record", F.when(F.col("page_id") == 2500, None).otherwise(F.col("record"))))) == [(2500, "missing")]
