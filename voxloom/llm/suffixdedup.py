"""Exact substring dedup with difference-cover suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
(in a smaller doc_id, or earlier in the same document).

1. *Which suffixes matter.*  In each window of ``length - GRAM + 1`` positions
   the least hash of GRAM bytes is the anchor (the leftmost of equals), so equal
   strings of ``length`` bytes hold equal anchors at the same distance.  Anchors
   are counted over the corpus; a start whose anchor occurs once cannot repeat,
   which leaves it out exactly.
2. *Distribution.*  Starts that share an anchor occurrence travel together with
   the bytes they need (a *context*) to the bucket of their anchor: equal
   strings meet there.  Contexts equal byte for byte are sent and sorted once;
   the starts of very frequent anchors go one by one to the bucket of their
   string, so no bucket grows with one passage.
3. *Suffix sorting.*  Each bucket sorts the suffixes of its contexts with the
   difference cover {1, 2} modulo 3: triples at sampled positions are sorted and
   named, the names are sorted by recursion (until they are unique or span
   ``length`` bytes, beyond which no order is needed), and the remaining third
   is ranked by its first byte and its neighbour's rank and merged in.
4. *Comparison.*  Adjacent suffixes whose ``length`` bytes are equal form a
   group; all but its earliest start are removed, and documents are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import binary, bucket_count, by_bucket, by_part, passing_tables, ragged, release_shuffles, steady, text_rows, trim, written
from voxloom.llm.corpuscount import text_blocks, unpack_texts, with_totals
from voxloom.llm.hashing import BASE, byte_table, mix, span_hashes

LENGTH = 100
GRAM = 32
#: Bytes hashed at a time, so that the arrays stay in a cache, and text of a bucket sorted at a time.
CHUNK_BYTES = 1 << 18
SORT_BYTES = 1 << 20
POSITION_BITS = np.uint64(24)
#: Starts of an anchor with more occurrences than this in the corpus travel one by one.
HOT_ANCHOR = 10_000


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position; ``size`` a power of 2."""
    h, base, span = byte_table()[data], BASE, 1
    while span < size:
        h = h[:-span] * base + h[span:]
        base = np.uint64(int(base) ** 2 % (1 << 64))
        span *= 2
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if width > span:
        values = np.minimum(values[: len(values) - (width - span)], values[width - span :])
    return values


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of every run of starts with one anchor: first start, number of starts,
    position of the anchor (all in ``data``) and the anchor's hash."""
    width = length - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int]] = []
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        a, b = int(offsets[at]), int(offsets[stop])
        if b - a <= CHUNK_BYTES:
            pieces.append((a, b))
        else:  # one long text: parts that overlap by a string less one byte
            pieces += [(k, min(b, k + CHUNK_BYTES + length - 1)) for k in range(a, max(a + 1, b - length + 1), CHUNK_BYTES)]
        at = stop
    for a, b in pieces:
        if b - a < length:
            continue
        grams = gram_hashes(data[a:b], gram)
        n = len(grams)
        ranked = (grams >> POSITION_BITS << POSITION_BITS) | np.arange(n, dtype=np.uint64)
        anchor = (sliding_min(ranked, width) & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)
        # a start needs its text to reach as far as its string
        ends = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left") + 1] - a
        inside = np.ones(len(anchor) + 1, np.int8)
        for e in ends.tolist():
            inside[max(0, e - length + 1) : e] = 0
        change = np.ones(len(anchor), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:-1] != inside[:-2])
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(anchor)))
        keep = inside[first] == 1
        first, count = first[keep], count[keep]
        out.append((first + a, count, anchor[first] + a, grams[anchor[first]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def names(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Ranks from 1 of rows of small non-negative numbers, equal for equal rows."""
    packed = columns[0].astype(np.uint64)
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 64:  # name a pair first
        pair, _ = names(columns[:2])
        return names([pair, *columns[2:]])
    for column, room in zip(columns[1:], bits[1:], strict=True):
        packed = packed << np.uint64(room) | column.astype(np.uint64)
    order = np.argsort(packed)
    ordered = packed[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(rank.max(initial=0))


def suffix_ranks(s: np.ndarray, span: int, needed: int) -> np.ndarray:
    """The order of the suffixes of ``s`` (numbers of at least 1, each standing
    for ``span`` bytes) by at least their first ``needed`` bytes; suffixes that
    agree in those stand side by side."""
    n = len(s)
    padded = np.concatenate([s, [0, 0, 0]])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    # sort the sampled triples and name them
    name, distinct = names([padded[sampled], padded[sampled + 1], padded[np.minimum(sampled + 2, n + 2)]])
    if distinct < len(sampled) and 3 * span < needed:
        # recurse on the names, those at 1 mod 3 and then those at 2 mod 3
        order = suffix_ranks(name, 3 * span, needed)
        name = np.empty(len(order), np.int64)
        name[order] = np.arange(1, len(order) + 1)
        distinct = len(order)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = name
    if distinct == len(sampled):  # names are places
        by_rank = np.empty_like(sampled)
        by_rank[name - 1] = sampled
    else:
        by_rank = sampled[np.argsort(name)]
    by_rank = by_rank[by_rank < n]
    # the remaining suffixes by first symbol and neighbour's rank
    rest = np.arange(0, n, 3)
    low = int(rank.max(initial=0)).bit_length()
    wide = int(padded.max(initial=0)).bit_length()
    key = lambda i: padded[i].astype(np.uint64) << np.uint64(low) | rank[i + 1].astype(np.uint64)
    own = key(rest)
    order = np.argsort(own)
    rest, own = rest[order], own[order]
    # merge: each remaining suffix goes after the sampled ones that are less
    one = by_rank[by_rank % 3 == 1]
    two = by_rank[by_rank % 3 == 2]
    less = np.searchsorted(np.maximum.accumulate(key(one)), own, "left") if len(one) else np.zeros(len(rest), np.int64)
    if len(two):
        if 2 * wide + low <= 64:
            double = lambda i: (padded[i].astype(np.uint64) << np.uint64(wide) | padded[i + 1].astype(np.uint64)) << np.uint64(low) | rank[i + 2].astype(np.uint64)
            theirs, mine = double(two), double(rest)
        else:
            both = np.concatenate([two, rest])
            name, _ = names([padded[both], padded[both + 1], rank[both + 2]])
            theirs, mine = name[: len(two)], name[len(two) :]
        less = less + np.searchsorted(np.maximum.accumulate(theirs), mine, "left")
    place = np.maximum.accumulate(less) + np.arange(len(rest)) if len(rest) else less
    merged = np.full(n, -1, np.int64)
    merged[place] = rest
    merged[merged < 0] = by_rank
    return merged


def equal_rows(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether data[a:a + length] and data[b:b + length] agree."""
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 14):
        out[k : k + (1 << 14)] = (windows[a[k : k + (1 << 14)]] == windows[b[k : k + (1 << 14)]]).all(1)
    return out


def later_starts(data: np.ndarray, first: np.ndarray, count: np.ndarray, order_of: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which starts of contexts are not the earliest of their string.

    Context k lies in ``data`` from first[k], with count[k] starts and
    ``length - 1`` bytes beyond; order_of[k] ranks its place in the corpus, with
    equal ranks for equal places.  Returns a flag for each start, by context.
    """
    starts = ragged(first, count)
    key = np.repeat(order_of, count) * 256 + ragged(np.zeros(len(count), np.int64), count)
    sizes = count + length - 1
    # contexts one after another, each closed by a 0; bytes count from 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text[ragged(begin, sizes)] = data[ragged(first, sizes)].astype(np.int64) + 1
    symbols = text + 1
    at = ragged(begin, count)
    slot = np.full(len(text), -1, np.int64)
    slot[at] = np.arange(len(at))
    order = suffix_ranks(symbols, 1, length)
    order = slot[order]
    order = order[order >= 0]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = equal_rows(data, starts[order[1:]], starts[order[:-1]], length)
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(key[order], heads) if len(heads) else key[:0]
    later = np.zeros(len(starts), bool)
    later[order] = key[order] > np.repeat(least, np.diff(np.append(heads, len(order))))
    return later


def place_ranks(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Dense ranks of (id, start)."""
    order = np.lexsort((starts, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (starts[order][1:] != starts[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def fold_equal(data: np.ndarray, first: np.ndarray, count: np.ndarray, lead: np.ndarray, hashes: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts to keep, and contexts that repeat an earlier one byte for byte
    (and so are later in every start).  A context at the same place as the one
    it repeats is kept."""
    order = np.lexsort((place, count, lead, hashes))
    a, b = order[1:], order[:-1]
    alike = (hashes[a] == hashes[b]) & (count[a] == count[b]) & (lead[a] == lead[b])
    repeats = np.zeros(len(order), bool)
    candidates = np.flatnonzero(alike) + 1
    for k in range(0, len(candidates), 4096):
        now = candidates[k : k + 4096]
        sizes = count[order[now]] + length - 1
        same = data[ragged(first[order[now]], sizes)] == data[ragged(first[order[now - 1]], sizes)]
        ends = np.cumsum(sizes)
        wrong = np.concatenate([[0], np.cumsum(~same)])
        repeats[now] = wrong[ends] == wrong[ends - sizes]
    # the head of each run of equals is its earliest; those at the head's place stay
    head = np.maximum.accumulate(np.where(repeats, 0, np.arange(len(order))))
    dropped = repeats & (place[order] > place[order[head]])
    return np.sort(order[~dropped]), order[dropped]


def split_hot(
    data: np.ndarray, hot: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, hashes: np.ndarray, length: int
) -> tuple[np.ndarray, ...]:
    """Contexts in which the starts of ``hot`` anchors stand alone, under a hash
    of their whole string in place of the anchor's.

    A passage in a third of all documents has anchors whose contexts differ in
    each of them where the passage ends; alone, its strings spread over all
    buckets, and those that are equal are still sent once a block.
    """
    if not hot.any():
        return first, count, anchor, hashes
    starts = ragged(first[hot], count[hot])
    order = np.argsort(starts, kind="stable")
    alone = np.empty(len(starts), np.uint64)
    alone[order] = span_hashes(data, starts[order], starts[order] + length)
    cold = ~hot
    return (
        np.concatenate([first[cold], starts]), np.concatenate([count[cold], np.ones(len(starts), count.dtype)]),
        np.concatenate([anchor[cold], np.repeat(anchor[hot], count[hot])]), np.concatenate([hashes[cold], alone]),
    )


CONTEXTS = "part int, block binary, bucket int, contexts binary, data binary, n_data long, gone binary"
REMOVED = "part int, block binary, gone binary"
#: A context's numbers: document in the block, id, start in the document, starts, anchor's distance, anchor.
FIELDS = 6


def contexts(rows: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """Contexts of starts that may repeat, packed by (block, bucket).  The rows
    of bucket -1 hold starts already known to be later, as (doc, start, n)."""

    hot = HOT_ANCHOR

    def finish(block, ids, missing, data, offsets, keys, total, first, count, anchor, hashes) -> pa.Table:
        repeated = total[np.searchsorted(keys, hashes)] > 1
        often = total[np.searchsorted(keys, hashes)][repeated]
        first, count, anchor, hashes = first[repeated], count[repeated], anchor[repeated], hashes[repeated]
        first, count, anchor, hashes = split_hot(data, often > hot, first, count, anchor, hashes, length)
        doc = np.searchsorted(offsets, first, "right") - 1
        start = first - offsets[doc]
        known = np.where(missing, np.iinfo(np.int64).min, ids)[doc]
        keep, later = fold_equal(data, first, count, anchor - first, hashes, place_ranks(known, start), length)
        gone = np.stack([doc[later], start[later], count[later]], 1).astype("<i8")
        columns: dict[str, list] = {x.split()[0]: [] for x in CONTEXTS.split(", ")}

        def put(bucket: int, numbers: np.ndarray, text: np.ndarray, over: np.ndarray) -> None:
            for name, value in (
                ("part", block[0]), ("block", block[1]), ("bucket", bucket), ("contexts", numbers.tobytes()),
                ("data", pa.compress(text.tobytes(), "zstd", asbytes=True)), ("n_data", len(text)), ("gone", over.tobytes()),
            ):
                columns[name].append(value)

        if len(gone):
            put(-1, np.zeros(0, "<i8"), data[:0], gone)
        to = (mix(hashes[keep]) % np.uint64(n_buckets)).astype(np.int64)
        by_bucket = np.argsort(to, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=n_buckets))])
        for b in np.flatnonzero(np.diff(cuts)):
            own = keep[by_bucket[cuts[b] : cuts[b + 1]]]
            numbers = np.stack([doc[own], known[own], start[own], count[own], (anchor - first)[own], hashes[own].view(np.int64)], 1)
            put(int(b), numbers.astype("<i8"), data[ragged(first[own], count[own] + length - 1)], gone[:0])
        kinds = {"part": pa.int32(), "block": pa.binary(), "bucket": pa.int32(), "contexts": pa.binary(), "data": pa.binary(), "n_data": pa.int64(), "gone": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})

    def keys(data: np.ndarray, offsets: np.ndarray) -> tuple:
        first, count, anchor, least = anchor_runs(data, offsets, length)
        hashes = mix(least)  # anchors are least hashes: their high bits are mostly 0, and would fill few buckets
        return *np.unique(hashes, return_counts=True), first, count, anchor, hashes

    return with_totals(rows, keys, finish, CONTEXTS, n_buckets)


def gone_of_bucket(group: pa.Table, length: int) -> pa.Table:
    """The rows of REMOVED of one bucket's contexts."""
    rows = group.to_pylist()
    numbers = np.concatenate([np.frombuffer(r["contexts"], "<i8").reshape(-1, FIELDS) for r in rows])
    source = np.repeat(np.arange(len(rows)), [len(r["contexts"]) // (8 * FIELDS) for r in rows])
    data = np.concatenate([np.frombuffer(pa.decompress(r["data"], r["n_data"], "zstd", asbytes=True), np.uint8) for r in rows])
    count = numbers[:, 3]
    sizes = count + length - 1
    first = np.cumsum(sizes) - sizes
    place = place_ranks(numbers[:, 1], numbers[:, 2])
    hashes = numbers[:, 5].copy().view(np.uint64)
    keep, later = fold_equal(data, first, count, numbers[:, 4], hashes, place, length)
    gone = [np.stack([source[later], numbers[later, 0], numbers[later, 2], count[later]], 1)]
    keep = keep[np.argsort(hashes[keep], kind="stable")]
    # equal strings share an anchor: sort suffixes anchor by anchor, many at a time
    heads = np.flatnonzero(np.concatenate([[True], hashes[keep][1:] != hashes[keep][:-1]])) if len(keep) else keep
    filled = np.concatenate([[0], np.cumsum(sizes[keep])])
    at = 0
    while at < len(heads):
        begin = heads[at]
        stop = max(at + 1, int(np.searchsorted(filled[heads], filled[begin] + SORT_BYTES, "right")) - 1)
        end = heads[stop] if stop < len(heads) else len(keep)
        own = keep[begin:end]
        later_flags = later_starts(data, first[own], count[own], place[own], length)
        owner = np.repeat(np.arange(len(own)), count[own])
        offset = ragged(np.zeros(len(own), np.int64), count[own])
        edge = np.ones(len(owner), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (later_flags[1:] != later_flags[:-1])
        begin_run = np.flatnonzero(edge)
        run_size = np.diff(np.append(begin_run, len(owner)))
        is_later = later_flags[begin_run]
        who, run_size, lead = own[owner[begin_run][is_later]], run_size[is_later], offset[begin_run][is_later]
        gone.append(np.stack([source[who], numbers[who, 0], numbers[who, 2] + lead, run_size], 1))
        at = stop
    del data, numbers, hashes, sizes, first, place, count
    trim()
    every = np.concatenate(gone)
    every = every[np.argsort(every[:, 0], kind="stable")]
    cuts = np.searchsorted(every[:, 0], np.arange(len(rows) + 1))
    used = np.flatnonzero(np.diff(cuts))
    return pa.table(
        {
            "part": pa.array([rows[k]["part"] for k in used], pa.int32()),
            "block": binary([rows[k]["block"] for k in used]),
            "gone": binary([every[cuts[k] : cuts[k + 1], 1:].astype("<i8").tobytes() for k in used]),
        }
    )


def removed_starts(found: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """(part, block, gone): starts that are not the earliest of their string."""
    dealt = by_bucket(found.filter("bucket >= 0"), n_buckets)
    return dealt.groupBy("bucket").applyInArrow(lambda group: gone_of_bucket(group, length), REMOVED)


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also
    starts earlier; strings are judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 and, with ``keep_text``, kept (binary: cuts may fall inside a
    character) and spans (array of start and length).

    Null texts are empty texts.  A missing id comes before all ids.  Rows that
    repeat an id are at the same place: neither is earlier than the other where
    they agree, and both keep such a string.  Texts below ``length`` bytes stay
    whole, long ones are judged whole; an empty table gives no rows, other
    columns are ignored.
    """
    if not GRAM < length < 256:
        raise ValueError(f"length must be above {GRAM} and below 256")
    rows = steady(text_rows(docs, id_col, text_col))
    n_buckets = bucket_count(rows)
    with passing_tables(docs.sparkSession) as result:
        found = written(contexts(rows, n_buckets, length), "contexts")
        release_shuffles(docs.sparkSession)
        gone = result(removed_starts(found, n_buckets, length).unionByName(found.filter("bucket < 0").select("part", "block", "gone")), "gone")
    release_shuffles(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        schema += ", kept binary, spans array<struct<start: long, length: long>>"

    def run(key, own: pa.Table, theirs: pa.Table) -> pa.Table:
        if not own.num_rows:
            raise RuntimeError("the two readings of the documents differ: a block has cuts and no documents")
        cuts = [np.frombuffer(x, "<i8").reshape(-1, 3) for x in theirs["gone"].to_pylist()]
        cut = np.concatenate([np.zeros((0, 3), np.int64), *cuts])
        out: dict[str, list] = {x: [] for x in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        for row in own.to_pylist():
            ids, missing, data, offsets = unpack_texts(row)
            change = np.zeros(len(data) + 1, np.int32)
            first = offsets[cut[:, 0]] + cut[:, 1]
            np.add.at(change, first, 1)
            np.add.at(change, first + cut[:, 2] + length - 1, -1)
            removed = np.cumsum(change[:-1]) > 0
            before = np.zeros(len(data), bool)
            before[1:] = removed[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            n_removed = np.concatenate([[0], np.cumsum(removed)])[offsets]
            n_spans = np.concatenate([[0], np.cumsum(removed & ~before)])[offsets]
            kept = data[~removed]
            kept_ends = offsets - n_removed
            raw = kept.tobytes()
            for k in range(len(ids)):
                a, b = int(offsets[k]), int(offsets[k + 1])
                text = raw[int(kept_ends[k]) : int(kept_ends[k + 1])]
                out["doc_id"].append(None if missing[k] else int(ids[k]))
                out["n_bytes"].append(b - a)
                out["n_removed"].append(int(n_removed[k + 1] - n_removed[k]))
                out["n_spans"].append(int(n_spans[k + 1] - n_spans[k]))
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    edges = np.flatnonzero(np.diff(removed[a:b].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    out["kept"].append(text)
                    out["spans"].append([{"start": int(s), "length": int(e - s)} for s, e in edges])
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        if keep_text:
            kinds |= {"kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))}
        return pa.table({k: pa.array(out[k], t) for k, t in kinds.items()})

    return by_part(text_blocks(rows, n_buckets), n_buckets).cogroup(by_part(gone, n_buckets)).applyInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with what ``cut_repeats`` keeps as
    their text (a character that a cut leaves incomplete goes too) and, if there
    is one, ``chars_col`` counted anew.

    Null texts stay null, empty ones empty; rows without an id keep their text.
    Rows that repeat an id and text are cut alike; an id with several texts is
    an error.  Columns may have any names; an empty table gives no rows.
    """
    given = docs.select(F.struct("*").alias("row"))
    row_id, row_text = F.col("row")[id_col].cast("long"), F.col("row")[text_col]
    own = given.select(row_id.alias("doc_id"), row_text.alias("text")).filter("doc_id is not null")
    cut = cut_repeats(own, length)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "kept"])

    decoded = cut.filter("n_removed > 0").select("doc_id", "kept").mapInArrow(decode, "id long, kept string")
    least, most = F.min("kept"), F.max("kept")
    several = F.raise_error(F.lit("an id has several texts: repeats can only be cut where ids tell texts apart"))
    kept = decoded.groupBy("id").agg(F.when(least == most, least).otherwise(several.cast("string")).alias("kept"))
    joined = given.join(kept, row_id == F.col("id"), "left")
    changed = {text_col: F.coalesce("kept", row_text.cast("string"))}
    if chars_col in docs.columns:
        counted = F.length("kept").cast(docs.schema[chars_col].dataType)
        changed[chars_col] = F.when(F.col("kept").isNull(), F.col("row")[chars_col]).otherwise(counted)
    return joined.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
