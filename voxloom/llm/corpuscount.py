"""Corpus-wide counts of 64-bit keys, brought back to the blocks of texts that
hold them.

A block of documents sends its distinct keys, sorted and packed, to buckets by
their high bits; a bucket adds up the counts of all blocks and answers each
block with the totals of the keys it sent, in the same order.  Keys are never
rows, so hundreds of millions of them cost a few thousand rows; a key that is
everywhere is one number a block.  The answer meets the block's texts again
(shuffled once, compressed), where the keys are computed anew, not stored.

A block is known by its part (dealt evenly, so no task gets many) and a digest
of its rows, so readings that differ cannot mix; ``rows`` have to be ``steady``,
so that they do not differ.  Blocks of one part that are equal row for row both
get the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.bytebpe import block_key
from voxloom.llm.common import BLOCK_BYTES, binary, blocks, by_bucket, by_part, byte_buffers, part_of, trim

#: (bytes, offsets) of a block -> its distinct keys in rising order, a count of
#: each, and whatever else ``finish`` wants of the way there.
Keys = Callable[[np.ndarray, np.ndarray], tuple]

TEXT_BLOCK = "part int, block binary, ids binary, missing binary, sizes binary, n_bytes long, texts binary"


def pack_texts(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    return {
        "ids": binary([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()]),
        "missing": binary([np.packbits(missing).tobytes()]),
        "sizes": binary([np.diff(offsets).astype("<i8").tobytes()]),
        "n_bytes": pa.array([len(data)], pa.int64()),
        "texts": binary([pa.compress(data.tobytes(), "zstd", asbytes=True)]),
    }


def unpack_texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, whether an id is missing, bytes and offsets."""
    ids = np.frombuffer(row["ids"], "<i8")
    missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(ids)).astype(bool)
    n = row["n_bytes"]
    data = np.frombuffer(pa.decompress(row["texts"], n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return ids, missing, data, np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], "<i8"))])


def text_blocks(rows: DataFrame, parts: int, limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of (doc_id, text) rows, packed, in ``parts`` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in enumerate(blocks(batches, "text", limit)):
            data, offsets = byte_buffers(block.column(1))
            key = block_key(block.column(0), data, offsets)
            place = {"part": pa.array([part_of(number, parts)], pa.int32()), "block": binary([key])}
            yield pa.RecordBatch.from_pydict(place | pack_texts(block.column(0), data, offsets))

    return rows.mapInArrow(run, TEXT_BLOCK)


def _planes(values: np.ndarray, width: int) -> bytes:
    raw = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").ravel()


def key_bits(n_buckets: int) -> int:
    return max(1, int(np.ceil(np.log2(n_buckets))))


def key_blocks(rows: DataFrame, keys: Keys, n_buckets: int, limit: int) -> DataFrame:
    """(part, block, bucket, n, keys, counts): what each block sends."""
    bits = key_bits(n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in enumerate(blocks(batches, "text", limit)):
            data, offsets = byte_buffers(block.column(1))
            own, counts = keys(data, offsets)[:2]
            if not len(own):
                continue
            key = block_key(block.column(0), data, offsets)
            cuts = np.searchsorted(own, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            cuts = np.append(cuts, len(own))
            used = np.flatnonzero(np.diff(cuts))
            parts = [slice(cuts[b], cuts[b + 1]) for b in used]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part_of(number, n_buckets)] * len(used), pa.int32()),
                    "block": binary([key] * len(used)),
                    "bucket": pa.array(used, pa.int32()),
                    "n": pa.array([p.stop - p.start for p in parts], pa.int32()),
                    "keys": binary([_planes(np.diff(own[p], prepend=np.uint64(0)), 8) for p in parts]),
                    "counts": binary([_planes(counts[p], 4) for p in parts]),
                }
            )

    return rows.mapInArrow(run, "part int, block binary, bucket int, n int, keys binary, counts binary")


def totals(sent: DataFrame, n_buckets: int) -> DataFrame:
    """(part, block, bucket, n, totals): the answers, in the order of the keys sent."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        rows = group.select(["n", "keys", "counts"]).to_pylist()
        sizes = np.array([r["n"] for r in rows])
        every = np.concatenate([np.cumsum(_unplanes(r["keys"], r["n"], 8)) for r in rows])
        counts = np.concatenate([_unplanes(r["counts"], r["n"], 4) for r in rows])
        order = np.argsort(every)
        ordered = every[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        del ordered
        sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first))
        total = np.empty(len(every), np.uint32)
        total[order] = np.minimum(sums, 0xFFFFFFFF).astype(np.uint32)[np.cumsum(first) - 1]
        ends = np.cumsum(sizes)
        del every, counts, order, first
        trim()
        return pa.table(
            {
                "part": group["part"], "block": group["block"], "bucket": pa.array([bucket] * len(rows), pa.int32()), "n": group["n"],
                "totals": binary([_planes(total[e - n : e], 4) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]),
            }
        )

    return by_bucket(sent, n_buckets).groupBy("bucket").applyInArrow(run, "part int, block binary, bucket int, n int, totals binary")


def with_totals(rows: DataFrame, keys: Keys, finish, schema: str, n_buckets: int, limit: int = BLOCK_BYTES) -> DataFrame:
    """Runs ``finish((part, block), ids, missing, data, offsets, keys, totals, ...)`` -> table
    on every block of ``rows`` (doc_id, text); ``totals[k]`` is the sum of the
    counts of ``keys[k]`` over all blocks."""

    def run(key, own: pa.Table, theirs: pa.Table) -> pa.Table:
        if not own.num_rows:
            raise RuntimeError("the two readings of the documents differ: a block has keys and no documents")
        answers = sorted(theirs.to_pylist(), key=lambda r: r["bucket"])
        seen: dict[int, np.ndarray] = {r["bucket"]: _unplanes(r["totals"], r["n"], 4) for r in answers}
        out = []
        for row in own.to_pylist():
            ids, missing, data, offsets = unpack_texts(row)
            mine, _, *more = keys(data, offsets)
            total = np.concatenate([np.zeros(0, np.uint32), *seen.values()])
            if len(total) != len(mine):
                raise RuntimeError("the two readings of the documents differ: a block lacks keys")
            out.append(finish((row["part"], row["block"]), ids, missing, data, offsets, mine, total, *more))
            del ids, missing, data, offsets, mine, total, more
            trim()
        return pa.concat_tables(out)

    answers = totals(key_blocks(rows, keys, n_buckets, limit), n_buckets)
    return by_part(text_blocks(rows, n_buckets, limit), n_buckets).cogroup(by_part(answers, n_buckets)).applyInArrow(run, schema)
