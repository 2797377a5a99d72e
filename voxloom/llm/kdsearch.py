"""Exact top-k search by inner product with a KD-tree for each shard.

Vectors are dealt by hash of their id to shards; each shard is one KD-tree of
median splits with tight bounding boxes, kept as one packed row.  Blocks of
queries meet every tree (a stated query set against all rows): for a query,
nodes are opened best first by the largest inner product their box allows, and
one whose bound is below the query's kth score is never opened.  A wave over one
shard for each block comes first; the kth scores it finds are propagated to the
searches of all other shards.

A tree is moved once for each block and a block once for each tree, so both are
as large as a worker's memory allows (65,536 vectors, 32,768 queries, searched
512 at a time) and only smaller where that would leave tasks without work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import binary, passing_tables, written

#: Rows of a shard and queries of a block: at most, and least where there are too few for all tasks.
SHARD_ROWS, LEAST_ROWS = 65_536, 4096
BLOCK_QUERIES, LEAST_QUERIES = 32_768, 512
LEAF_ROWS = 64
EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, dim and the vector as packed int64 floor(scale * x).

    Vectors that are null, empty, hold a null or a non-finite component, or have
    no id take no part; one that reaches 2^63 after scaling is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed = [], [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not values.is_valid or not len(values.values) or values.values.null_count:
                    continue
                given = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(given).all():
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.floor(given * scale)
                if np.abs(scaled).max() >= float(1 << 63):
                    raise ValueError(f"vector {vec_id} does not fit 64 bits after scaling")
                ids.append(vec_id)
                dims.append(len(scaled))
                packed.append(scaled.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "dim": pa.array(dims, pa.int32()), "vector": binary(packed)})

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, dim int, vector binary")


def build(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A KD-tree: the order of rows, and of each node its row range, its
    children (-1: a leaf) and its tight box (low, high)."""
    order = np.arange(len(vectors))
    ranges, children, boxes = [], [], []

    def box(a: int, b: int) -> int:
        own = vectors[order[a:b]]
        ranges.append((a, b))
        children.append((-1, -1))
        boxes.append((own.min(0), own.max(0)))
        return len(ranges) - 1

    todo = [box(0, len(vectors))]
    while todo:
        node = todo.pop()
        a, b = ranges[node]
        low, high = boxes[node]
        if b - a <= leaf_rows or (low == high).all():
            continue
        wide = int(np.argmax(high - low))
        mid = (a + b) // 2
        order[a:b] = order[a:b][np.argpartition(vectors[order[a:b], wide], mid - a)]
        children[node] = (box(a, mid), box(mid, b))
        todo.extend(children[node])
    return order, np.array(ranges), np.array(children), np.array(boxes)


def parts_of(n: int, most: int, least: int, wanted: int) -> int:
    """Parts of n rows: of ``most`` rows each, or of fewer (``least`` if there
    are as many) where that gives up to ``wanted`` parts."""
    return max(1, -(-n // most), min(-(-n // least), wanted))


def search(
    tree: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray
) -> list[list[tuple[int, int]]]:
    """The k best (score, -id) of each query in one tree, given the kth scores
    known so far (NONE: none).  ``tree`` is (ranges, children, boxes); ``vectors`` and ``ids`` are in tree order."""
    ranges, children, boxes = tree
    top = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    kind = np.float64 if top < EXACT else object
    v, q = vectors.astype(kind), queries.astype(kind)
    zero = np.zeros(1, kind)
    bounds = np.maximum(q, zero) @ boxes[:, 1].astype(kind).T + np.minimum(q, zero) @ boxes[:, 0].astype(kind).T
    spans, kids = ranges.tolist(), children.tolist()
    found = []
    for j, own_id in enumerate(query_ids.tolist()):
        bound = bounds[j].tolist()
        floor = int(kth[j])
        best: list[tuple[int, int]] = []  # a heap; its least is the kth
        heap = [(-bound[0], 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            if floor != NONE and -reach < floor:
                break
            left, right = kids[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            a, b = spans[node]
            scores = v[a:b] @ q[j]
            for at in range(b - a) if floor == NONE else np.flatnonzero(scores >= floor).tolist():
                other = int(ids[a + at])
                if other == own_id:
                    continue
                entry = (int(scores[at]), -other)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        found.append(best)
    return found


TREE = "dim int, shard int, ids binary, vectors binary, ranges binary, children binary, boxes binary"
HIT = "query_id long, score long, vec_id long"


def trees(rows: DataFrame, shards: int) -> DataFrame:
    """One packed KD-tree for each (dim, shard)."""

    def run(group: pa.Table) -> pa.Table:
        dim, shard = group["dim"][0].as_py(), group["shard"][0].as_py()
        ids = group["vec_id"].to_numpy()
        vectors = np.frombuffer(b"".join(group["vector"].to_pylist()), "<i8").reshape(-1, dim)
        arrived = np.argsort(ids, kind="stable")
        ids, vectors = ids[arrived], vectors[arrived]
        order, ranges, children, boxes = build(vectors)
        small = "<i4" if np.abs(vectors).max() < 1 << 31 else "<i8"
        parts = (ids[order].astype("<i8"), vectors[order].astype(small), ranges.astype("<i4"), children.astype("<i4"), boxes.astype("<i8"))
        columns = dict(zip(("ids", "vectors", "ranges", "children", "boxes"), (binary([x.tobytes()]) for x in parts), strict=True))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32())} | columns)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(run, TREE)


def query_blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Packed blocks of queries: dim, block, query_ids, queries.  Of repeated
    ids the least vector asks."""

    def run(group: pa.Table) -> pa.Table:
        own = group.sort_by("vec_id")
        packed = {"query_ids": own["vec_id"].to_numpy().astype("<i8").tobytes(), "queries": b"".join(own["vector"].to_pylist())}
        keys = {"dim": pa.array([own["dim"][0].as_py()], pa.int32()), "block": pa.array([own["block"][0].as_py()], pa.int32())}
        return pa.table(keys | {k: binary([v]) for k, v in packed.items()})

    once = rows.groupBy("vec_id").agg(F.min(F.struct("vector", "dim")).alias("row")).select("vec_id", "row.dim", "row.vector")
    dealt = once.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block int, query_ids binary, queries binary")


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """Hits of every (tree, block of queries) row; ``kth`` holds bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids = np.frombuffer(row["ids"], "<i8")
                wide = "<i4" if len(row["vectors"]) == 4 * dim * len(ids) else "<i8"
                tree = (
                    np.frombuffer(row["ranges"], "<i4").reshape(-1, 2),
                    np.frombuffer(row["children"], "<i4").reshape(-1, 2),
                    np.frombuffer(row["boxes"], "<i8").reshape(-1, 2, dim),
                )
                vectors = np.frombuffer(row["vectors"], wide).reshape(-1, dim).astype(np.int64)
                query_ids = np.frombuffer(row["query_ids"], "<i8")
                queries = np.frombuffer(row["queries"], "<i8").reshape(-1, dim)
                known = dict(zip(row["bound_ids"] or [], row["bound_scores"] or [], strict=True))
                kth = np.array([known.get(x, NONE) for x in query_ids.tolist()], np.int64)
                for a in range(0, len(query_ids), LEAST_QUERIES):
                    some = slice(a, a + LEAST_QUERIES)
                    hits = search(tree, ids, vectors, query_ids[some], queries[some], k, kth[some])
                    flat = [(q, s, -i) for q, own in zip(query_ids[some].tolist(), hits, strict=True) for s, i in own]
                    yield pa.RecordBatch.from_pydict({n: pa.array([x[j] for x in flat], pa.int64()) for j, n in enumerate(("query_id", "score", "vec_id"))})

    return pairs.mapInArrow(run, HIT)


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None
) -> DataFrame:
    """The ``k`` highest integer inner products of each query, ties to the
    smaller id: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows of other ids and equal length.  Rows that take no part are listed in
    ``quantised``; scores are exact, and one beyond 64 bits among a shard's best
    is an error.  A repeated row is a candidate each time; a repeated query
    id asks once.  Fewer than ``k`` candidates: all of them.  An empty table or
    one without queries gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with passing_tables(spark) as result:
        rows = written(quantised(vectors, id_col, vector_col, scale), "vectors")
        n = rows.count()
        asks = rows.filter(F.col("vec_id") % every == 0)
        n_asks = asks.count()
        shards = max(1, -(-n // shard_rows)) if shard_rows else parts_of(n, SHARD_ROWS, LEAST_ROWS, partitions)
        n_blocks = parts_of(n_asks, BLOCK_QUERIES, LEAST_QUERIES, -(-partitions // shards))
        forest = written(trees(rows, shards), "trees")
        asking = written(query_blocks(asks, n_blocks), "queries")
        return result(ranked(forest, asking, k, shards, n_blocks, max(6, min(shards * n_blocks, 4 * partitions))), "ranked")


def ranked(forest: DataFrame, asking: DataFrame, k: int, shards: int, n_blocks: int, tasks: int) -> DataFrame:
    """The k best rows of each query of all blocks in all trees."""
    # each block against the one shard of its number, then against all others
    first = asking.withColumn("shard", F.pmod("block", F.lit(shards)).cast("int"))
    none = (F.lit(None).cast("array<long>").alias("bound_ids"), F.lit(None).cast("array<long>").alias("bound_scores"))
    wave = first.join(forest.hint("shuffle_hash"), ["dim", "shard"]).select("*", *none)
    home = written(searched(wave.repartition(tasks, "dim", "shard", "block"), k), "first-hits")

    bounds = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    block_of = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(n_blocks)).cast("int")
    packed = bounds.groupBy(block_of.alias("block")).agg(
        F.collect_list("query_id").alias("bound_ids"), F.collect_list("kth").alias("bound_scores")
    )
    asked = asking.join(packed.hint("shuffle_hash"), "block", "left")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    others = asked.select("*", every_shard).filter(F.col("shard") != F.pmod("block", F.lit(shards)))
    pairs = others.join(forest.hint("shuffle_hash"), ["dim", "shard"])
    rest = searched(pairs.repartition(tasks, "dim", "shard", "block"), k)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    every = home.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return every.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
