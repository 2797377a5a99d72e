"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate where it stands on more than ``max_ratio`` of its site's
pages (and on at least ``min_pages``).  Only hashes of lines are shuffled, each
once a page and pre-aggregated; a site can have at most (lines a page) /
max_ratio boilerplate lines, so its list is short, and texts are filtered
where they are read: they are never shuffled when the lists are few enough to
broadcast (their number is checked), and dealt by salted site otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import written

MAX_RATIO, MIN_PAGES = 0.05, 5
#: Lines of all lists together that may be broadcast: 24 bytes each.
BROADCAST_LINES = 100_000
SALTS = 64


def host_of(url: Column) -> Column:
    """The site of a URL: its host, lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def line_key(line: Column) -> Column:
    """Identifies a line, blanks at its ends aside: 96 bits of two hashes."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.hash(F.trim(line)).alias("b"))


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and lines: the keys of each site's boilerplate lines."""
    pages = docs.select(host.alias("host"), text.alias("text"))
    visible = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    keys = F.array_distinct(F.transform(visible, line_key))
    counts = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = pages.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("pages"))
    often = counts.filter(F.col("n") >= min_pages).join(totals, F.col("host").eqNullSafe(F.col("site")))
    often = often.filter(F.col("n") > F.lit(float(max_ratio)) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, host: Column, text_col: str = "text", id_col: str = "doc_id", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with n_lines, n_dropped and
    ``kept``, its text without its site's boilerplate lines.

    A null text stays null and has no lines; an empty text is one line, which
    stays, as all blank lines do.  Rows without a site are a site of their own.
    Repeated rows are pages each.  An empty table gives no rows.  Columns of
    ``docs`` stay inside ``row``, so none can clash.
    """
    if not 0 <= max_ratio <= 1 or min_pages < 1:
        raise ValueError("max_ratio is from 0 to 1 and min_pages at least 1")
    text = F.col(text_col).cast("string")
    lists = written(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    n = lists.select(F.sum(F.size("lines"))).first()[0] or 0
    sites = lists.select(F.col("host").alias("site"), "lines")
    pages = docs.select(F.struct("*").alias("row"), host.alias("host"), text.alias("text"), F.col(id_col).alias("id"))
    if n <= BROADCAST_LINES:
        dealt = pages.join(F.broadcast(sites), F.col("host").eqNullSafe(F.col("site")), "left")
    else:
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("id", "text"), F.lit(SALTS)).cast("int")
        dealt = pages.withColumn("own", own).join(salted, F.col("host").eqNullSafe(F.col("site")) & (F.col("own") == F.col("salt")), "left")
    lines = F.split("text", "\n", -1)
    stays = F.filter(lines, lambda x: (F.trim(x) == "") | F.col("lines").isNull() | ~F.array_contains(F.col("lines"), line_key(x)))
    dealt = dealt.withColumn("stays", F.when(F.col("lines").isNull(), lines).otherwise(stays))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    return dealt.select(
        "row",
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines - F.size("stays")).cast("long").alias("n_dropped"),
        F.array_join("stays", "\n").alias("kept"),
    )
