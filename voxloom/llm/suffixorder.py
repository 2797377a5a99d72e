"""The distributed difference-cover algorithm: a global order of all suffixes.

Every step is a relation with a row for each suffix, so no task and no driver
holds more than a range of it:

1. triples at positions 1 and 2 modulo 3 are sorted and named over the corpus;
2. the names are texts again (two for each text: those at 1 and those at 2
   modulo 3), whose suffixes are ordered by recursion until a name spans
   ``length`` symbols, beyond which no order is needed;
3. the suffixes at 0 modulo 3 are merged in: how many sampled ones are less is
   a count over the order of (symbol, rank of the next) and over that of
   (symbol, next symbol, rank of the one after);
4. adjacent suffixes are compared by their first ``length`` bytes.

``suffixdedup`` finds the same starts with far less shuffled; the README has the
figures of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import byte_buffers, passing_tables, ragged, release_shuffles, written

#: Suffixes that a range of the global order holds.
RANGE_ROWS = 1 << 21
#: Symbols that leave a Python worker in one batch.
BATCH_ROWS = 1 << 20


def symbols(texts: DataFrame) -> DataFrame:
    """s, c, p and v: the bytes of every text, counted from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = byte_buffers(batch.column(1))
            sizes = np.diff(offsets)
            owner, place = np.repeat(ids, sizes), ragged(np.zeros(len(sizes), np.int64), sizes)
            for k in range(0, len(data), BATCH_ROWS):
                own = slice(k, k + BATCH_ROWS)
                v = data[own].astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array(owner[own]), pa.array(np.zeros(len(v), np.int64)), pa.array(place[own]), pa.array(v)], ["s", "c", "p", "v"])

    return texts.select("s", "text").mapInArrow(run, "s long, c long, p long, v long")


def ranked(rows: DataFrame, keys: list[str], weight: Column, ranges: int) -> DataFrame:
    """``rows`` with before: the total weight of the rows whose keys are less.

    Equal keys are added up on the map side first.  The sorted ranges are
    written once with their number; the driver sees one total for each."""
    sums = rows.groupBy(*keys).agg(F.sum(weight).cast("long").alias("w"))
    ranged = written(sums.repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id()), "ranges")
    upto, offsets = 0, []
    for number, total in sorted(ranged.groupBy("range").agg(F.sum("w")).collect()):
        offsets.append((number, upto))
        upto += total
    base = rows.sparkSession.createDataFrame(offsets, "range int, base long")
    inside = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("within", F.coalesce(F.sum("w").over(inside), F.lit(0)))
    places = within.join(F.broadcast(base), "range").select(*keys, (F.col("within") + F.col("base")).alias("before"))
    return rows.join(places, keys)


def suffix_ranks(level: DataFrame, span: int, needed: int, ranges: int) -> DataFrame:
    """s, c, p and r (from 1) of every suffix of ``level`` (s, c, p, v): the order
    by at least the first ``needed`` bytes, of which a symbol spans ``span``."""
    kind = F.col("p") % 3
    text = Window.partitionBy("s", "c").orderBy("p")
    ahead = lambda name, k: F.lead(name, k, 0).over(text)
    # sort and name the sampled triples
    triples = level.withColumn("v1", ahead("v", 1)).withColumn("v2", ahead("v", 2)).filter(kind != 0)
    named = ranked(triples, ["v", "v1", "v2"], F.lit(1), ranges)
    names = written(named.select("s", (2 * F.col("c") + kind - 1).alias("c"), F.floor(F.col("p") / 3).alias("p"), (F.col("before") + 1).alias("v")), "names")
    # recurse on the names
    deeper = names.withColumnRenamed("v", "r") if 3 * span >= needed else suffix_ranks(names, 3 * span, needed, ranges)
    up = deeper.select("s", F.shiftright("c", 1).alias("c"), (3 * F.col("p") + 1 + F.col("c") % 2).alias("p"), "r")
    # merge the remaining suffixes
    known = level.join(up, ["s", "c", "p"], "left")
    known = known.withColumn("v1", ahead("v", 1)).withColumn("r1", ahead("r", 1)).withColumn("r2", ahead("r", 2))
    known = written(known.fillna(0, ["r1", "r2"]), "known")
    release_shuffles(level.sparkSession)
    ones = ranked(known.filter(kind != 2), ["v", "r1"], F.when(kind == 1, 1).otherwise(0), ranges)
    twos = ranked(known.filter(kind != 1), ["v", "v1", "r2"], F.when(kind == 2, 1).otherwise(0), ranges)
    less = ones.filter(kind == 0).select("s", "c", "p", "v", "r1", F.col("before").alias("less"))
    less = less.unionByName(twos.filter(kind == 0).select("s", "c", "p", "v", "r1", F.col("before").alias("less")))
    rest = less.groupBy("s", "c", "p").agg(F.sum("less").alias("less"), F.first("v").alias("v"), F.first("r1").alias("r1"))
    rest = rest.select("s", "c", "p", "less", F.lit(0).alias("sampled"), "v", "r1")
    zero = F.lit(0).cast("long")
    sampled = known.filter(kind != 0).select("s", "c", "p", (F.col("r") - 1).alias("less"), F.lit(1).alias("sampled"), zero.alias("v"), zero.alias("r1"))
    merged = written(rest.unionByName(sampled), "merged")
    found = ranked(merged, ["less", "sampled", "v", "r1"], F.lit(1), ranges)
    out = written(found.select("s", "c", "p", (F.col("before") + 1).alias("r")), "ranks")
    release_shuffles(level.sparkSession)
    return out


def repeated_starts(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and start (in bytes) of every string of ``length`` bytes that also
    starts earlier, in a smaller doc_id or earlier in the same document.

    Null texts are empty; texts below ``length`` bytes and empty tables give no
    rows.  A missing id comes before all ids; rows that repeat an id are at the
    same place.  Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    with passing_tables(docs.sparkSession) as result:
        texts = written(own.withColumn("s", F.monotonically_increasing_id()), "texts")
        size = F.octet_length("text").cast("long")
        n_bytes, longest = texts.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
        if longest < length:
            return docs.sparkSession.createDataFrame([], "doc_id long, start long")
        ranges = max(8, -(-n_bytes // RANGE_ROWS))
        level = written(symbols(texts), "symbols")
        ranks = suffix_ranks(level, 1, length, ranges).select("s", "p", "r")
        long_enough = texts.filter(F.octet_length("text") >= length)
        starts = long_enough.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("text").cast("long") - length)))
        starts = starts.select("s", "p", "doc_id", F.substring("text", F.col("p").cast("int") + 1, F.lit(length)).alias("string"))
        ordered = starts.join(ranks, ["s", "p"]).repartitionByRange(ranges, "r").withColumn("range", F.spark_partition_id())
        ordered = written(ordered, "ordered")
        # each range's first string against the last of the range before it
        edges = ordered.groupBy("range").agg(F.max_by("string", "r").alias("last"))
        before = edges.select("range", F.lag("last").over(Window.orderBy("range")).alias("edge"))
        inside = Window.partitionBy("range").orderBy("r", "s", "p")
        previous = F.coalesce(F.lag("string").over(inside), F.col("edge"))
        head = F.when(previous == F.col("string"), 0).otherwise(1)
        headed = written(ordered.join(F.broadcast(before), "range").withColumn("head", head).drop("string", "edge"), "headed")
        sums = headed.groupBy("range").agg(F.sum("head").alias("n"))
        upto = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        grouped = headed.join(F.broadcast(sums.select("range", upto.alias("base"))), "range")
        grouped = grouped.withColumn("g", F.sum("head").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("base"))
        place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.col("p"))
        grouped = written(grouped.select("g", "doc_id", "p", place.alias("place")), "grouped")
        least = grouped.groupBy("g").agg(F.min("place").alias("least"), F.count("*").alias("n")).filter("n > 1")
        later = grouped.join(least, "g").filter("place > least")
        return result(later.select("doc_id", F.col("p").alias("start")), "later")
