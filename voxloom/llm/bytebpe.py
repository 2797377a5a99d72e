"""Byte-level BPE through one global shuffle of distinct words.

1. *Explode*: a block of documents is cut into pre-tokens.  The block keeps a
   dictionary of its distinct pre-tokens and, for every document, the positions
   as indexes into that dictionary (frequent words first, byte planes
   compressed).
2. *Encode once*: the dictionaries are shuffled by word hash, so every distinct
   word of the corpus meets in one bucket and is encoded there once.
3. *Join back*: the ids return to the blocks that asked for them.
4. *Reassemble*: each block lays the ids of its words along its positions;
   decoding joins the ids with the token-byte table.  That table is as long as
   the rank file, so it is the build side that every worker holds once, and the
   probe is one gather of offsets and one of bytes for a block.

A word that fills a third of the corpus is still one dictionary entry a block,
so no key is hot.  Words go to buckets whose number follows the bytes of the
texts, so no bucket grows with the input.  The explode step runs twice (once for
each side of the last join) in place of storing the corpus; rows that a rerun
task could see in another order are written first (``steady``).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import binary, blocks, bucket_count, by_bucket, by_part, byte_buffers, part_of, ragged, steady, text_rows, trim

EXPLODE_BYTES = 8 << 20
#: Fixed value: the pre-token pattern whose texts may be cut before blanks; with any other, texts are matched whole.
CUT_BEFORE_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pattern that takes any text as one pre-token.
WHOLE = r"(?s:.+)"
#: White space of Unicode, as the pre-token pattern's \s has it.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where cutting before each blank could split one run of white space in two.
LONG_SPACE = f"{SPACE}{{3}}|{SPACE}{{2}}$"


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line for each token, its bytes in base64 and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def load_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("bytebpe", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@cache
def word_encoder(path: str):
    """Ids of one pre-token; a worker loads a rank file once."""
    return load_encoding(path, WHOLE).encode_ordinary


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: where a token's bytes begin, how many they
    are (-1: there is no such id), and the bytes of all tokens."""
    ranks = load_ranks(path)
    size = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
    size[list(ranks.values())] = [len(token) for token in ranks]
    by_id = sorted(ranks, key=ranks.get)
    return np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), size, np.frombuffer(b"".join(by_id), np.uint8)


def joined_bytes(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids joined with the token-byte table: bytes of all one after another
    and how many each has.  An id that the table does not hold is an error."""
    start, size, data = token_bytes(path)
    known = (ids >= 0) & (ids < len(size))
    if not known.all() or (size[ids] < 0).any():
        raise ValueError("an id is not in the token-byte table")
    return data[ragged(start[ids], size[ids])], size[ids]


def explode(texts: pa.Array, pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, their indexes along all texts, and pre-tokens a text.

    A pre-token never runs from visible text into white space, so a text cut
    before each blank falls into the same pre-tokens, except where a run of
    white space has two blanks to cut at; such texts are matched whole, as all
    are if ``pattern`` is not CUT_BEFORE_BLANKS.
    """
    n = len(texts)
    if pattern.pattern == CUT_BEFORE_BLANKS:
        whole = pc.match_substring_regex(texts, LONG_SPACE).to_numpy(zero_copy_only=False).astype(bool)
    else:
        whole = np.ones(n, bool)
    pieces = pc.split_pattern(texts, " ")
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    first = offsets[:-1]
    encoded = pieces.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    words: dict[str, int] = {}
    flat: list[int] = []
    starts, counts = [], []

    def put(found: list[str]) -> None:
        starts.append(len(flat))
        counts.append(len(found))
        flat.extend([words.setdefault(w, len(words)) for w in found])

    find = pattern.findall
    spaced_too = [] if whole.all() else encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    for piece in spaced_too:
        put([" " + piece] if piece.isalpha() else find(" " + piece))
    spaced = len(starts)
    heads = encoded.dictionary.take(encoded.indices.take(pa.array(first))).to_pylist()
    for k, head in enumerate(heads):
        put(find(texts[k].as_py()) if whole[k] else find(head))
    codes[first] = spaced + np.arange(n)
    if whole.any():
        inside = np.repeat(whole, np.diff(offsets))
        inside[first] = False
        keep = ~inside
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    start, count = np.array(starts, np.int64), np.array(counts, np.int64)
    per_piece = count[codes]
    index = np.array(flat, np.int64)[ragged(start[codes], per_piece)]
    ends = np.concatenate([[0], np.cumsum(per_piece)])
    return list(words), index, ends[offsets[1:]] - ends[offsets[:-1]]


def ranked(words: list[str], index: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The dictionary by falling frequency, so that most positions are small."""
    order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return [words[k] for k in order], place[index]


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes: most high bytes are 0."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def block_key(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> bytes:
    """Equal only for blocks of equal rows, whose dictionaries are equal too."""
    digest = hashlib.blake2b(digest_size=16)
    digest.update(repr(ids.to_pylist()).encode())
    digest.update(offsets.tobytes())
    digest.update(data.tobytes())
    return digest.digest()


def word_bucket(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """A bucket from each word's bytes: equal words, equal buckets."""
    size = np.diff(offsets)
    mixed = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(min(24, int(size.max(initial=0)))):
        has = size > k
        mixed[has] = (mixed[has] ^ data[offsets[:-1][has] + k]) * np.uint64(0x100000001B3)
    mixed ^= mixed >> np.uint64(33)
    return (mixed % np.uint64(n)).astype(np.int64)


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


DOC_SIDE = "part int, block binary, ids binary, missing binary, counts binary, n long, positions binary"
WORD_SIDE = "part int, block binary, bucket int, n int, slots binary, sizes binary, words binary"
CODE_SIDE = "part int, block binary, n int, slots binary, counts binary, codes binary"


def exploded(docs: DataFrame, pattern: str, n_buckets: int, side: str) -> DataFrame:
    """The document side (positions) or the word side (dictionaries) of step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        for number, block in enumerate(blocks(batches, "text", EXPLODE_BYTES)):
            part = part_of(number, n_buckets)
            ids, texts = block.column(0), block.column(1)
            key = block_key(ids, *byte_buffers(texts))
            words, index, counts = explode(texts, compiled)
            words, index = ranked(words, index)
            if side == "docs":
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part], pa.int32()),
                        "block": binary([key]),
                        "ids": binary([ids.fill_null(0).to_numpy().astype("<i8").tobytes()]),
                        "missing": binary([np.packbits(missing).tobytes()]),
                        "counts": binary([counts.astype("<i8").tobytes()]),
                        "n": pa.array([len(index)], pa.int64()),
                        "positions": binary([pack_numbers(index)]),
                    }
                )
                continue
            if not words:
                continue
            data, offsets = byte_buffers(pa.array(words, pa.large_string()))
            to = word_bucket(data, offsets, n_buckets)
            order = np.argsort(to, kind="stable")
            sizes = np.diff(offsets)
            sorted_data = data[ragged(offsets[:-1][order], sizes[order])]
            sizes = sizes[order]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=n_buckets))])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            used = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * len(used), pa.int32()),
                    "block": binary([key] * len(used)),
                    "bucket": pa.array(used, pa.int32()),
                    "n": pa.array([int(cuts[b + 1] - cuts[b]) for b in used], pa.int32()),
                    "slots": binary([pack_numbers(np.diff(order[cuts[b] : cuts[b + 1]], prepend=0)) for b in used]),
                    "sizes": binary([pack_numbers(sizes[cuts[b] : cuts[b + 1]]) for b in used]),
                    "words": binary([pa.compress(sorted_data[ends[cuts[b]] : ends[cuts[b + 1]]].tobytes(), "zstd", asbytes=True) for b in used]),
                }
            )

    return docs.mapInArrow(run, DOC_SIDE if side == "docs" else WORD_SIDE)


def coded(words: DataFrame, path: str, n_buckets: int) -> DataFrame:
    """Step 2: each distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        known: dict[str, np.ndarray] = {}
        bucket = None
        for batch in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in CODE_SIDE.split(", ")}
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    known, bucket = {}, row["bucket"]
                codes, counts = [], []
                sizes = unpack_numbers(row["sizes"], row["n"])
                words = np.frombuffer(pa.decompress(row["words"], int(sizes.sum()), "zstd", asbytes=True), np.uint8)
                for w in strings(words, sizes).to_numpy(zero_copy_only=False).tolist():
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w)
                    codes += got
                    counts.append(len(got))
                out["part"].append(row["part"])
                out["block"].append(row["block"])
                out["n"].append(row["n"])
                out["slots"].append(row["slots"])
                out["counts"].append(pack_numbers(np.array(counts)))
                out["codes"].append(pack_numbers(np.array(codes)))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32()) if k in ("part", "n") else binary(v) for k, v in out.items()})

    return by_bucket(words, n_buckets).sortWithinPartitions("bucket").mapInArrow(run, CODE_SIDE)


def encode_decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """Token ids of every whole text and the bytes they decode to.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex; ids
    as little-endian unsigned 32-bit integers) and, with ``keep_ids``, ids
    (array<int>) and decoded (binary).

    Null texts are empty texts (0 tokens, digests of nothing).  Null ids stay
    null, repeated rows give repeated results, an empty table gives none, and
    other columns, whatever their names, are ignored.  A text of any length is
    encoded whole; one longer than a block is a block of its own.
    """
    rows = steady(text_rows(docs, id_col, text_col))
    n_buckets = bucket_count(rows)
    left = exploded(rows, pattern, n_buckets, "docs")
    right = coded(exploded(rows, pattern, n_buckets, "words"), path, n_buckets)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded binary"

    def reassemble(key, own: pa.Table, theirs: pa.Table) -> pa.Table:
        if not own.num_rows:
            raise RuntimeError("the two readings of the documents differ: a block has words and no documents")
        slots, counts, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for row in theirs.to_pylist():
            slots.append(np.cumsum(unpack_numbers(row["slots"], row["n"]), dtype=np.int64))
            counts.append(unpack_numbers(row["counts"], row["n"]).astype(np.int64))
            codes.append(unpack_numbers(row["codes"], int(counts[-1].sum())))
        slot, count, code = map(np.concatenate, (slots, counts, codes))
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        n_words = int(slot.max(initial=-1)) + 1
        at, size = np.full(n_words, -1, np.int64), np.zeros(n_words, np.int64)
        at[slot], size[slot] = first, count
        if (at < 0).any():
            raise RuntimeError("the two readings of the documents differ: a block lacks words")
        out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for row in own.to_pylist():
            ids = np.frombuffer(row["ids"], "<i8")
            missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(ids))
            positions = unpack_numbers(row["positions"], row["n"])
            if len(positions) and int(positions.max()) >= n_words:
                raise RuntimeError("the two readings of the documents differ: a block lacks words")
            end = 0
            for doc_id, null, n in zip(ids.tolist(), missing, np.frombuffer(row["counts"], "<i8").tolist(), strict=True):
                here = positions[end : end + n]
                end += n
                tokens = code[ragged(at[here], size[here])]
                decoded = joined_bytes(tokens.astype(np.int64), path)[0].tobytes()
                out["doc_id"].append(None if null else doc_id)
                out["n_tokens"].append(len(tokens))
                out["ids_sha256"].append(hashlib.sha256(tokens.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    out["ids"].append(tokens.astype(np.int32))
                    out["decoded"].append(decoded)
        types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        if keep_ids:
            types |= {"ids": pa.list_(pa.int32()), "decoded": pa.binary()}
        trim()
        return pa.table({k: pa.array(out[k], t) for k, t in types.items()})

    return by_part(left, n_buckets).cogroup(by_part(right, n_buckets)).applyInArrow(reassemble, schema)


def token_table(spark, path: str) -> DataFrame:
    """The token-byte table: id, token (binary); as long as the rank file."""
    return spark.createDataFrame(
        pa.table({"id": pa.array((r := load_ranks(path)).values(), pa.int32()), "token": pa.array(list(r), pa.binary())})
    )


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of arrays of ids by a join with the token-byte table.

    Returns doc_id, decoded.  A null or empty array decodes to nothing; an
    array that holds a null or an id outside the table is an error.  Rows with
    equal ids and equal arrays are decoded each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(1).fill_null([])
            flat = arrays.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, sizes = joined_bytes(flat, path)
            token_ends = np.concatenate([[0], np.cumsum(sizes)])
            counts = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int64)
            ends, raw = token_ends[counts].tolist(), data.tobytes()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": binary([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])})

    rows = ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded binary")
