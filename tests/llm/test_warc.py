"""WARC: round trip, and faults found where they are."""

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from voxloom.llm import catalogue, warc

PAGES = "page_id long, url string, html string"


def pages(spark, n=40):
    rows = [(k * 50, f"http://h/{k}", f"<p>é {k}</p>" * (k % 5)) for k in range(n)] + [(None, None, None), (7, "u", "")]
    return warc.page_records(spark.createDataFrame(rows, PAGES))


def found(primary, replica):
    return sorted((r["page_id"], r["status"]) for r in warc.audit(primary, replica).collect())


def test_round_trip(spark):
    frame = pages(spark)
    read = warc.read_files(warc.warc_files(frame))
    assert read.count() == 42
    row = read.filter("url = 'http://h/4'").first()
    assert bytes(row["payload"]).decode() == "<p>é 4</p>" * 4
    places = warc.ranges(frame)
    joined = read.alias("r").join(places.alias("p"), (F.col("r.file_no") == F.col("p.file_no")) & (F.col("record_no") == F.col("at")))
    assert joined.filter("r.start = p.start and r.length = p.end - p.start").count() == 42


@pytest.mark.parametrize("bad", [b"x", b"WARC/1.0\r\nContent-Length: 5\r\n\r\nab", b"WARC/1.0\r\nContent-Length: 1\r\n\r\na\r\n\r\nrest"])
def test_damaged_file(bad):
    with pytest.raises(ValueError):
        list(warc.parse_warc(bad))


def test_equal_replicas(spark):
    assert found(pages(spark), pages(spark)) == []
    assert found(pages(spark).limit(0), pages(spark).limit(0)) == []


def test_faults(spark):
    frame = pages(spark)
    wrong = frame.withColumn("record", F.when(F.col("page_id") == 500, F.lit(b"junk")).when(F.col("page_id") == 1950, F.lit(b"")).otherwise(F.col("record")))
    assert found(frame, wrong) == [(500, "corrupt"), (1950, "missing")]
    last = frame.filter("page_id <> 1950 or page_id is null")
    assert found(frame, last) == [(1950, "missing")] and found(last, frame) == [(1950, "extra")]


def test_levels_agree_with_a_plain_tree(spark):
    import hashlib

    records = warc.ranges(pages(spark)).withColumn("n", F.col("end") - F.col("start")).withColumn("place", warc.place(F.col("page_id"), F.col("hash")))
    rows = records.filter("file_no = 1").orderBy("at").collect()
    level = {r["page_id"] - warc.FILE_PAGES: (r["end"] - r["start"], r["hash"]) for r in rows}
    for _ in range(warc.FILE_LEVELS):
        above = {}
        for at in sorted(level):
            above.setdefault(at // warc.FANOUT, []).append((at, *level[at]))
        level = {up: (sum(n for _, n, _ in own), hashlib.sha256(";".join(":".join(map(str, x)) for x in own).encode()).hexdigest()) for up, own in above.items()}
    root = warc.merkle_levels(records, ["file_no"])[warc.FILE_LEVELS].filter("file_no = 1").collect()
    assert len(root) == 1 and level == {root[0]["at"]: (root[0]["length"], root[0]["hash"])}


def test_query(spark, sf_dir, duck):
    same_rows(catalogue.op3_warc_audit(spark, sf_dir), catalogue.oracle_sql()["op3_warc_audit"], duck)
