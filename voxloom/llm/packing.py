"""Bounded-space online best-fit packing of tokenised documents.

Tokens are counted in one pass over the texts.  Pieces are then dealt by hash
to shards of a bounded number of pieces; in each shard pieces arrive in hash
order, by windows of a few thousand with the longest first in each (the rest of
the best fit's waste goes with that: 0.02 % in place of 0.7 %), and go to the
fullest open bin that has room.  Open bins are a bitset
keyed by free space (bit f: some open bin has f free), so the best fit is the
lowest set bit at or above the length.  Only ``open_bins`` bins stay open; when
one more is needed, the fullest closes first.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import blocks, ragged, text_rows, written

CAPACITY = 4096
OPEN_BINS = 1024
#: Pieces of an arrival window; longest first in each.
WINDOW = 4000
SHARD_PIECES = 60_000
#: Entries of a worker's cache of encoded words; it empties when full.
CACHE_WORDS = 300_000
#: Below this code point, lower case is by character and normalisation changes nothing.
PLAIN_BELOW = 0x250
#: Fixed value: what splits normalised text into pre-tokens, as the vocabulary's file has it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in printable}
    rest = iter(range(0x100, 0x200))
    return [names[b] if b in names else chr(next(rest)) for b in range(256)]


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file's texts may be cut at white space and its words
    lower-cased and split here: the file says so step by step, its model keeps
    no state between words, and its added tokens are plain strings that hold a
    character which is no letter, and no white space."""
    normal = (spec.get("normalizer") or {}).get("normalizers") or []
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model, added = spec.get("model") or {}, spec.get("added_tokens") or []
    return (
        [n.get("type") for n in normal] == ["NFC", "Replace", "Lowercase"]
        and normal[1].get("pattern") == {"Regex": r"\s+"} and normal[1].get("content") == " "
        and [n.get("type") for n in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        and model.get("type") == "BPE" and not model.get("dropout")
        and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
        and all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in added)
        and all(t["content"].isascii() and t["content"].isprintable() and " " not in t["content"] and not t["content"].isalpha() for t in added)
    )


class WordTokenizer:
    """Ids of a whole text from a cache of its distinct words.

    The vocabulary's pre-tokens never hold white space, so a text's ids are
    those of its white-space chunks one after another.  Chunks of plain letters
    go to the model directly; any other chunk takes the full tokenizer, as one
    with an added token does.  A file that is not of this kind (see
    ``splits_at_blanks``) has every whole text encoded by the library.

    Ids are those of the library as the file sets it up: added tokens in a text
    are found.  ``special_as_text`` makes them ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_chunks = splits_at_blanks(spec)
        self.find = regex.compile(SPLIT).findall
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = regex.compile("|".join(map(regex.escape, added)) if added else r"(?!)").search
        self.model = self.full.model
        self.letters = byte_alphabet()
        self.known: dict[str, bytes] = {"": b""}

    def keep(self, text: str, ids: bytes) -> bytes:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
            self.known[""] = b""
        self.known[text] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            name = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = [t.id for t in self.model.tokenize(name)]
            got = self.keep(piece, struct.pack(f"<{len(ids)}I", *ids))
        return got

    def chunk(self, chunk: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not chunk.isascii() and (ord(max(chunk)) >= PLAIN_BELOW or "İ" in chunk or "\x85" in chunk or "\xa0" in chunk):
            return self.keep(chunk, self.whole(chunk))
        lower = chunk.lower()
        if lower.isalpha():
            return self.word(lower)
        if not lower.isprintable() or self.added(chunk):
            return self.keep(chunk, self.whole(chunk))
        return self.keep(chunk, b"".join([self.word(piece) for piece in self.find(lower)]))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and ids a text."""
        if not self.by_chunks:
            each = [np.frombuffer(self.whole(t), "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy().astype(np.int64)
        encoded = split.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy().astype(np.int64)
        known = self.known.get
        found = []
        for chunk in encoded.dictionary.to_numpy(zero_copy_only=False).tolist():
            ids = known(chunk)
            found.append(self.chunk(chunk) if ids is None else ids)
        count = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        start = np.cumsum(count) - count
        per_chunk = count[codes]
        ids = np.frombuffer(b"".join(found), "<u4")[ragged(start[codes], per_chunk)]
        ends = np.concatenate([[0], np.cumsum(per_chunk)])
        return ids, ends[offsets[1:]] - ends[offsets[:-1]]


_tokenizers: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, with its cache."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then ``end_id``; only one longer than
    ``capacity`` is cut, into pieces of that length and a shorter last one.
    Null and empty texts are the single ``end_id``.  Added tokens in a text
    have their own ids, as the library gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        for block in blocks(batches, "text"):
            ids, counts = tokenizer.texts(block.column(1))
            raw = memoryview(np.insert(ids, np.cumsum(counts), end_id).astype("<u4").tobytes())
            sizes = counts + 1
            first = np.cumsum(sizes) - sizes
            n_pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n_pieces)
            piece = ragged(np.zeros(len(sizes), np.int64), n_pieces)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            begin = 4 * (first[doc] + start)
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            columns = {"doc_id": block.column(0).take(pa.array(doc)), "piece": pa.array(piece, pa.int32())}
            columns |= {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: Iterable[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and place in the bin of each length, in order of arrival."""
    free_bits = 0
    by_free: dict[int, list[int]] = {}
    n_open = n_bins = 0
    bins, places = [], []
    for need in lengths:
        above = free_bits >> need
        if above:
            free = need + (above & -above).bit_length() - 1
            stack = by_free[free]
            own = stack.pop()
            if not stack:
                free_bits ^= 1 << free
        else:
            if n_open == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                n_open -= 1
            own, free = n_bins, capacity
            n_bins += 1
            n_open += 1
        bins.append(own)
        places.append(capacity - free)
        free -= need
        if free:
            by_free.setdefault(free, []).append(own)
            free_bits |= 1 << free
        else:
            n_open -= 1
    return bins, places


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (of ``token_pieces``).

    Shards hold about ``shard_pieces`` pieces whatever the input's size, dealt
    by hash of id and piece, so neither a hot source nor a long document is one
    task.  Ties go by the hash order; repeated rows are packed each.  A
    length below 1 or above ``capacity`` is an error.  No pieces: no rows.
    """
    held = written(pieces, "pieces")
    shards = max(1, -(-held.count() // shard_pieces))
    mixed = F.xxhash64("doc_id", "piece")

    def run(batch: pa.Table) -> pa.Table:
        arrived = batch.sort_by([("mixed", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = arrived["length"].to_numpy()
        window = np.arange(len(sizes)) // WINDOW
        arrived = arrived.take(pa.array(np.lexsort((-sizes, window))))
        lengths = arrived["length"].to_pylist()
        if lengths and not 0 < min(lengths) <= max(lengths) <= capacity:
            raise ValueError(f"lengths must be 1 to {capacity}")
        bins, places = best_fit(lengths, capacity, open_bins)
        first = batch["shard"][0].as_py() << 36
        own = arrived.drop_columns(["mixed", "shard"])
        own = own.append_column("sequence_id", pa.array(np.array(bins, np.int64) + first))
        return own.append_column("offset", pa.array(places, pa.int64()))

    dealt = held.withColumn("mixed", mixed).withColumn("shard", F.pmod("mixed", F.lit(shards)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(run, schema)


def pack_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Packs whole documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset; in
    a sequence the offsets are gapless from 0.  Nulls, empty and long texts are
    as ``token_pieces`` says, ties and repeated rows as ``pack`` says.  Other
    columns are ignored; an empty table gives no rows.
    """
    return pack(token_pieces(docs, path, id_col, text_col, end_id, capacity), capacity, open_bins)
