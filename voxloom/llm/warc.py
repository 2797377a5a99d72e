"""Merkle fixity audit of WARC replicas.

A WARC file is an ordered run of records; a record is an offset range with a
SHA-256.  Records have a place in their file by their id, not by their ordinal,
and FANOUT neighbouring places make a node, whose hash covers the ordered
lengths (so the ranges inside the node) and hashes of its children, up to a root
for the file; files make a tree of their own up to the replica's root.  A record
that is lost or added so changes the nodes above it and no others.

Two replicas are compared from the root down.  Every level is written once; the
roots are compared first and replicas that agree end there; else only children
of nodes that differ are looked at, level by level, and the records of differing
places are matched by hash.  What is shuffled to build the trees is an id, a
length and a hash a record.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import passing_tables, trim, written

FANOUT = 16
#: Ids a file: a file holds the pages of this many consecutive ids.
FILE_PAGES = 1000
#: Files of pages without an id, which are dealt by content; their numbers are negative.
NAMELESS_FILES = 1 << 20
#: Levels from a place to its file's root: FANOUT ** 3 places and more fit.
FILE_LEVELS = 3
#: Bytes of a volume: a file of more is laid out in several, one after another.
VOLUME_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def record_head(page_id: Column, url: Column, n_bytes: Column) -> Column:
    """The header of a response record, up to and with its blank line."""
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), page_id.cast("string"),
        F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), n_bytes.cast("string"), F.lit(CRLF + CRLF),
    )


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, file_no and record (binary) of each page.  A page without an id
    is -1, in one of NAMELESS_FILES by its content; one without URL or text has
    an empty one; repeated rows are records each."""
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    head = record_head(F.col("page_id"), F.col("url"), F.octet_length("html"))
    record = F.concat(head, F.col("html"), F.lit(CRLF + CRLF)).cast("binary")
    nameless = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(NAMELESS_FILES))
    file_no = F.when(F.col("page_id") < 0, nameless).otherwise(F.floor(F.col("page_id") / FILE_PAGES)).cast("long")
    return rows.select("page_id", file_no.alias("file_no"), record.alias("record"))


def ranges(records: DataFrame) -> DataFrame:
    """page_id, file_no, at (place in the file), start, end and hash of each
    record.  Order is by id; of a repeated id by hash."""
    own = records.select("page_id", "file_no", F.octet_length("record").cast("long").alias("n"), F.sha2("record", 256).alias("hash"))
    return placed(own, Window.partitionBy("file_no").orderBy("page_id", "hash", "n")).drop("n")


def placed(records: DataFrame, order) -> DataFrame:
    """Adds at, start and end to records (n bytes each) in the order of a window
    of their file; the window streams and spills, so a file may be of any size."""
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = (F.row_number().over(order) - 1).cast("long")
    with_end = records.withColumn("at", at).withColumn("end", upto)
    return with_end.withColumn("start", F.col("end") - F.col("n"))


def warc_files(records: DataFrame) -> DataFrame:
    """file_no, volume, first (places before it), base (bytes before it) and
    content: each file's records in order of id.  A file is a binary of about
    VOLUME_BYTES, a larger one several, so no task holds a file of any size."""
    own = records.withColumn("n", F.octet_length("record").cast("long")).withColumn("hash", F.sha2("record", 256))
    laid = placed(own, Window.partitionBy("file_no").orderBy("page_id", "hash", "n"))
    laid = laid.select("file_no", F.floor(F.col("start") / VOLUME_BYTES).cast("int").alias("volume"), "at", "start", "record")

    def run(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("at")
        content = b"".join(ordered["record"].to_pylist())
        keys = {c: ordered[c].slice(0, 1) for c in ("file_no", "volume", "at", "start")}
        return pa.table({"file_no": keys["file_no"], "volume": keys["volume"], "first": keys["at"], "base": keys["start"], "content": pa.array([content], pa.binary())})

    return laid.groupBy("file_no", "volume").applyInArrow(run, "file_no long, volume int, first long, base long, content binary")


def parse_warc(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, headers and payload of each record; a damaged header or
    a short record is an error."""
    at = 0
    while at < len(content):
        head_end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or head_end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:head_end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        end = head_end + 4 + size
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, end + 4 - at, headers, content[head_end + 4 : end]
        at = end + 4


RECORD_ID = re.compile(rb"(?im)^WARC-Record-ID:[ \t]*<urn:page:(-?\d{1,18})>\r?$")
NEXT = re.compile(rb"\r\n\r\n(?=WARC/1\.)")


def scan_warc(content: bytes) -> Iterator[tuple[int, int, int | None]]:
    """start, end and page id of each record of a file that may be damaged: what
    does not parse lasts until the next record begins, without an id if none
    can be read."""
    at = 0
    while at < len(content):
        head_end = content.find(b"\r\n\r\n", at)
        head = content[at:head_end] if head_end >= 0 else b""
        size = re.search(rb"(?im)^Content-Length:[ \t]*(\d{1,18})\r?$", head)
        end = head_end + 4 + int(size[1]) + 4 if size and head.startswith(b"WARC/") else -1
        if not (0 < end <= len(content) and content[end - 4 : end] == b"\r\n\r\n"):
            later = NEXT.search(content, at + 1)
            end = later.end() if later else len(content)
        name = RECORD_ID.search(head) if head_end < end else None
        yield at, end, int(name[1]) if name else None
        at = end


def row_by_row(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch; of large values one row's at a time is held."""
    for k in range(batch.num_rows):
        yield tuple(column[k].as_py() for column in batch.columns)
    trim()


def read_files(files: DataFrame) -> DataFrame:
    """Records of ``warc_files`` rows: file_no, record_no, start, length, url
    and payload; a damaged file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("file_no", "record_no", "start", "length", "url", "payload")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            for file_no, first, base, content in row_by_row(batch):
                found = [(file_no, first + k, base + a, n, h.get("warc-target-uri", ""), p) for k, (a, n, h, p) in enumerate(parse_warc(content or b""))]
                yield pa.RecordBatch.from_pydict({x: pa.array([r[j] for r in found], kinds[j]) for j, x in enumerate(names)})

    return files.select("file_no", "first", "base", "content").mapInArrow(run, "file_no long, record_no long, start long, length long, url string, payload binary")


def indexed(files: DataFrame) -> DataFrame:
    """``ranges`` of the records found in the bytes of ``warc_files`` rows.
    Bytes that belong to no readable record take the id after the one before
    them, where a damaged record was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "file_no", "at", "start", "end", "hash")
        for batch in batches:
            for file_no, first, base, content in row_by_row(batch):
                found, before = [], None
                for k, (a, b, page_id) in enumerate(scan_warc(content or b"")):
                    if page_id is None:
                        page_id = -1 if file_no < 0 else file_no * FILE_PAGES if before is None else before + 1
                    found.append((page_id, file_no, first + k, base + a, base + b, hashlib.sha256(content[a:b]).hexdigest()))
                    before = page_id
                kinds = [pa.int64()] * 5 + [pa.string()]
                yield pa.RecordBatch.from_pydict({x: pa.array([r[j] for r in found], kinds[j]) for j, x in enumerate(names)})

    return files.select("file_no", "first", "base", "content").mapInArrow(run, "page_id long, file_no long, at long, start long, end long, hash string")


def place(page_id: Column, hash_: Column) -> Column:
    """A record's place among its file's leaves: by id, without one by hash."""
    by_hash = F.conv(F.substring(hash_, 1, 6), 16, 10).cast("long")
    return F.pmod(F.when(page_id < 0, by_hash).otherwise(page_id), F.lit(FILE_PAGES)).cast("long")


def leaves(records: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves of records (file_no, place, n, hash): at, length and hash of each
    place.  A place has one record as a rule; of several, the hash covers their
    number and sums of parts of their hashes, which need no order and no list."""
    part = lambda k: F.sum(F.conv(F.substring("hash", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    several = F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[part(k).cast("string") for k in range(4)]), 256)
    one = F.when(F.count("*") == 1, F.max("hash")).otherwise(several)
    return records.groupBy(*keys, F.col("place").alias("at")).agg(F.sum("n").alias("length"), one.alias("hash"))


def parents(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes one level up: the hash covers the children's places, lengths and
    hashes in order, at most FANOUT of them."""
    child = F.sort_array(F.collect_list(F.struct("at", "length", "hash")))
    text = F.array_join(F.transform(child, lambda c: F.concat_ws(":", c["at"], c["length"], c["hash"])), ";")
    up = F.floor(F.col("at") / FANOUT).cast("long").alias("up")
    grouped = nodes.groupBy(*keys, up).agg(F.sum("length").alias("length"), F.sha2(text, 256).alias("hash"))
    return grouped.withColumnRenamed("up", "at").select(*keys, "at", "length", "hash")


def merkle_levels(records: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Levels of every file's tree, from places (0) to its root, each written."""
    levels = [written(leaves(records, keys), "places")]
    for k in range(FILE_LEVELS):
        levels.append(written(parents(levels[-1], keys), f"nodes-{k + 1}"))
    return levels


def differing(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys at which the two sides differ: hashes differ or one has no node."""
    sides = nodes.groupBy(*keys).agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    return sides.filter("n < 2 or low <> high").select(*keys)


def below(frontier: DataFrame, level: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes of ``level`` under the differing nodes of the one above."""
    up = frontier.select(*[F.col(k).alias(f"u_{k}") for k in keys])
    on = [F.col("u_at") == F.floor(F.col("at") / FANOUT)] + [F.col(f"u_{k}") == F.col(k) for k in keys if k != "at"]
    return level.join(up, on, "left_semi")


FOUND = "page_id long, file_no long, record_no long, start long, end long, status string"


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Where ``replica`` differs from ``primary`` (both page_id, file_no, record).

    Returns page_id, file_no, record_no, start, end (the primary's) and status:
    "corrupt" (other bytes), "missing" (no record) or "extra" (a record only the
    replica has, with its own place).  A record without bytes is no record.
    Records of one id that are equal are matched first; of what is left, the
    first of one side stands against the first of the other, and so on, so of
    repeated rows each counts.  Records without an id (-1) have their places by
    hash: a changed one is missing and extra.  Null records are records without
    bytes.  Replicas that agree return no rows, and nothing below the roots is
    looked at; empty replicas agree; other columns are ignored.
    """
    return audit_ranges(ranges(primary), ranges(replica))


def audit_files(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``audit`` of two tables of ``warc_files``, by the records that are found
    in their bytes, damaged or not."""
    return audit_ranges(indexed(primary), indexed(replica))


def audit_ranges(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``audit`` of two tables of record ranges."""
    spark = primary.sparkSession
    sides = [x.select(F.lit(k).alias("side"), "page_id", "file_no", "at", "start", "end", "hash") for k, x in enumerate((primary, replica))]
    with passing_tables(spark) as result:
        every = sides[0].unionByName(sides[1]).filter("end > start").withColumn("place", place(F.col("page_id"), F.col("hash")))
        records = written(every.withColumn("n", F.col("end") - F.col("start")), "records")
        inside = merkle_levels(records, ["side", "file_no"])
        archive = [inside[-1].select("side", F.col("file_no").alias("at"), "length", "hash")]
        most = archive[0].agg(F.max(F.abs("at"))).first()[0] or 0
        while FANOUT ** (len(archive) - 1) <= most:
            archive.append(written(parents(archive[-1], ["side"]), "nodes"))
        # the roots: one a side, and one more for files with negative numbers
        frontier = differing(archive[-1], ["at"])
        if not frontier.collect():
            return spark.createDataFrame([], FOUND)
        for level in archive[-2::-1]:
            frontier = written(differing(below(frontier, level, ["at"]), ["at"]), "files")
        keys = ["file_no", "at"]
        frontier = frontier.select(F.col("at").alias("file_no"), F.lit(0).cast("long").alias("at"))
        for level in inside[-2::-1]:
            frontier = written(differing(below(frontier, level, keys), keys), "frontier")
        return result(matched(records.join(frontier.withColumnRenamed("at", "place"), ["file_no", "place"], "left_semi")), "found")


def matched(records: DataFrame) -> DataFrame:
    """What differs among the records of differing places."""
    ids = ["file_no", "place", "page_id"]
    again = F.row_number().over(Window.partitionBy("side", *ids, "hash").orderBy("start"))
    equal = records.withColumn("again", again).groupBy(*ids, "hash", "again")
    alone = equal.agg(F.count("*").alias("n"), F.first(F.struct("side", "at", "start", "end")).alias("r")).filter("n = 1").select(*ids, "r.*")
    turn = F.row_number().over(Window.partitionBy("side", *ids).orderBy("start"))
    own = lambda side: F.max(F.when(F.col("side") == side, F.struct("at", "start", "end")))
    pairs = alone.withColumn("turn", turn).groupBy(*ids, "turn").agg(own(0).alias("p"), own(1).alias("r"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("p").isNull(), "extra").otherwise("corrupt")
    where = F.coalesce("p", "r")
    return pairs.select("page_id", "file_no", where["at"].alias("record_no"), where["start"].alias("start"), where["end"].alias("end"), status.alias("status"))


def damaged(files: DataFrame, lost: Callable[[int], bool], flipped: Callable[[int], bool]) -> DataFrame:
    """A replica of ``warc_files`` rows with faults in its bytes: records whose
    page id is ``lost`` are cut out, of those that are ``flipped`` the 13th byte
    is another.  For rehearsing audits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"file_no": pa.int64(), "volume": pa.int32(), "first": pa.int64(), "base": pa.int64()}
        for batch in batches:
            for *keys, content in row_by_row(batch):
                kept = []
                for a, b, page_id in scan_warc(content):
                    if page_id is None or page_id < 0:
                        kept.append(content[a:b])
                    elif not lost(page_id):
                        kept.append(content[a : a + 12] + b"\0" + content[a + 13 : b] if flipped(page_id) else content[a:b])
                columns = {name: pa.array([v], t) for v, (name, t) in zip(keys, kinds.items(), strict=True)}
                yield pa.RecordBatch.from_pydict(columns | {"content": pa.array([b"".join(kept)], pa.binary())})

    schema = "file_no long, volume int, first long, base long, content binary"
    return files.select("file_no", "volume", "first", "base", "content").mapInArrow(run, schema)
