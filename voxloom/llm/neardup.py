"""Near-duplicate classes by improved consistent weighted sampling (ICWS).

1. Five-word shingles of every text are weighted tf * idf, with document
   frequencies counted over the whole corpus (``corpuscount``).
2. A text whose shingles found in other documents carry less than the
   threshold of its weight cannot reach the threshold with any text; this exact
   test leaves few texts to sample.
3. Texts of equal words are one node; ICWS draws BANDS * ROWS samples of each.
   A sample of two texts agrees with the probability of their weighted Jaccard
   similarity; ROWS samples make a band key.
4. Texts that share a band key are candidates.  Links are verified by the
   weighted Jaccard similarity of the whole texts, bucket leaders first; then
   texts under one leader that are still apart meet in tiles, where only links
   become rows.  A pair is skipped only where its texts are already linked
   through others, so every pair of candidates is decided.
5. Linked texts form classes by alternating large-star and small-star rounds;
   each step's links are edges between the classes so far, so later steps work
   on what they join and not on all links again.

The idf is damped (1 for a shingle that is everywhere, 1 + ``IDF_SPAN`` for one
that stands alone): with the plain logarithm the edits of a copy in a large
group would outweigh what it shares, and 0.8 would lose its meaning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import binary, bucket_count, passing_tables, release_shuffles, steady, text_rows, trim, written
from voxloom.llm.corpuscount import with_totals
from voxloom.llm.hashing import mix, shingle_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
IDF_SPAN = 0.1
#: Hashes are shuffled to be counted: a byte less of each is a byte less to move.  Of n distinct shingles a given
#: one shares its 56 bits with another at a chance of n / 2^56: one in 70,000 for 10^12 shingles.
KEPT_BITS = np.uint64(0xFFFFFFFFFFFFFF00)
#: Texts of either role in a tile of a canopy, and shingles of a matrix slab.
TILE, SLAB = 512, 4096
#: Parts that the texts of one leader are dealt to.
SALTS = 16
#: Cells of the sampling matrix computed at a time.
CELLS = 1 << 18
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def text_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (56 bits) in order, and shingles a text; ASCII case is folded."""
    hashes, counts = shingle_hashes(*word_hashes(FOLD[data], offsets), size)
    return hashes & KEPT_BITS, counts


def by_key(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes, texts that hold each, and of each (hash, text) in order
    of hash: the hash's index, the text and the term frequency."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(hashes, kind="stable")
    h, t = hashes[order], text[order]
    new_hash = np.ones(len(h), bool)
    new_hash[1:] = h[1:] != h[:-1]
    new_pair = new_hash.copy()
    new_pair[1:] |= t[1:] != t[:-1]
    pair = np.flatnonzero(new_pair)
    index = (np.cumsum(new_hash) - 1)[pair]
    frequency = np.diff(np.append(pair, len(h)))
    return h[new_hash], np.bincount(index, minlength=int(new_hash.sum())), index, t[pair], frequency


def damped_idf(df: np.ndarray, n_docs: int, span: float = IDF_SPAN) -> np.ndarray:
    """From 1 + span (one document) down to 1 (all documents)."""
    if n_docs < 2:
        return np.full(len(df), 1.0 + span)
    return 1 + span * np.log(n_docs / np.minimum(df, n_docs)) / np.log(n_docs)


WEIGHTED = "doc_id long, digest binary, n int, hashes binary, weights binary"


def weighted_shingles(rows: DataFrame, n_docs: int, n_buckets: int, size: int, threshold: float, idf_span: float) -> DataFrame:
    """Of each text that may have a partner: a digest of its words' shingles,
    the distinct shingles in rising order, and their weights."""

    def keys(data: np.ndarray, offsets: np.ndarray) -> tuple:
        hashes, counts = text_shingles(data, offsets, size)
        return *by_key(hashes, counts), hashes, counts

    def finish(block, ids, missing, data, offsets, own, total, index, text, frequency, hashes, counts) -> pa.Table:
        df = total[index]
        weight = frequency * damped_idf(df, n_docs, idf_span)
        n = len(ids)
        whole = np.bincount(text, weight, n)
        shared = np.bincount(text, weight * (df > 1), n)
        may = (shared >= threshold * whole - 1e-9) & ~missing
        by_text = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[by_text], np.arange(n + 1))
        ends = np.cumsum(counts)
        chosen = np.flatnonzero(may)
        out: dict[str, list] = {x: [] for x in ("digest", "hashes", "weights")}
        for k in chosen:
            pair = by_text[cuts[k] : cuts[k + 1]]
            out["digest"].append(hashlib.blake2b(hashes[ends[k] - counts[k] : ends[k]].tobytes(), digest_size=16).digest())
            out["hashes"].append(own[index[pair]].astype("<u8").tobytes())
            out["weights"].append(weight[pair].astype("<f4").tobytes())
        columns = {"doc_id": pa.array(ids[chosen], pa.int64()), "n": pa.array(np.diff(cuts)[chosen], pa.int32())}
        return pa.table(columns | {k: binary(v) for k, v in out.items()}).select(["doc_id", "digest", "n", "hashes", "weights"])

    return with_totals(rows, keys, finish, WEIGHTED, n_buckets)


def icws(hashes: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """Samples of one weighted set, each a hash of the drawn (shingle, level).

    For sample k, shingle s of weight w: r, c ~ Gamma(2, 1) and b ~ U(0, 1) from
    hashes of (s, k); t = floor(ln w / r + b), ln a = ln c - r (t - b) - r; the
    shingle of least a is drawn at level t.
    """
    seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low, half = np.uint64(0xFFFFFFFF), np.float32(2**-32)

    def uniform(bits: np.ndarray) -> np.ndarray:
        return (bits.astype(np.float32) + np.float32(0.5)) * half

    best = np.full(samples, np.inf, np.float32)
    drawn = np.zeros(samples, np.uint64)
    step = max(1, CELLS // samples)
    for a in range(0, len(hashes), step):
        s = hashes[a : a + step, None]
        m1 = mix(s ^ seeds)
        m2 = mix(m1 + np.uint64(0xD1B54A32D192ED03))
        r = -np.log(uniform(m1 >> np.uint64(32)) * uniform(m1 & low))
        c = -np.log(uniform(m2 >> np.uint64(32)) * uniform(m2 & low))
        b = uniform(mix(m2 + np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(32))
        r = np.maximum(r, np.float32(1e-6))
        t = np.floor(np.log(weights[a : a + step, None]) / r + b)
        ln_a = np.log(np.maximum(c, np.float32(1e-30))) - r * (t - b) - r
        at = np.argmin(ln_a, 0)
        least = ln_a[at, np.arange(samples)]
        better = least < best
        best[better] = least[better]
        level = t[at, np.arange(samples)].astype(np.int64).view(np.uint64)
        drawn[better] = mix(s[at, 0] + level * np.uint64(0x9E3779B97F4A7C15))[better]
    return drawn


def band_keys(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band_key, doc_id) of every text that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, hashes, weights in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                drawn = icws(np.frombuffer(hashes, "<u8"), np.frombuffer(weights, "<f4"), bands * rows).reshape(bands, rows)
                key = np.arange(bands, dtype=np.uint64)
                for k in range(rows):
                    key = mix(key + drawn[:, k])
                ids += [doc_id] * bands
                keys.append(key.view(np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            trim()
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64()), pa.array(ids, pa.int64())], ["band_key", "doc_id"])

    return texts.select("doc_id", "hashes", "weights").mapInArrow(run, "band_key long, doc_id long")


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of minima over sum of maxima; a and b are distinct and rising."""
    if len(a) > len(b):
        a, wa, b, wb = b, wb, a, wa
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    same = b[at] == a if len(b) else np.zeros(len(a), bool)
    both = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    union = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - both
    return both / union if union else 1.0


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                one, w1, two, w2 = (np.frombuffer(x, d) for x, d in zip(row, ("<u8", "<f4", "<u8", "<f4"), strict=True))
                keep.append(weighted_jaccard(one, w1, two, w2) >= threshold - 1e-7)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            trim()

    one = texts.select(F.col("doc_id").alias("a"), F.col("hashes").alias("h1"), F.col("weights").alias("w1"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("hashes").alias("h2"), F.col("weights").alias("w2"))
    full = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "h1", "w1", "h2", "w2")
    return full.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not the least of
    those it is connected to; that is its root.  Alternates large-star and small-star until nothing changes;
    edges are only ever rows."""
    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        current = written(small.distinct(), "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def tile_links(group: pa.Table, threshold: float) -> pa.Table:
    """Links between the texts of role x and those of role y in one tile of a
    canopy: for each x the best y of every other root that reaches the threshold.

    The dot product of square roots of weights bounds the sum of minima from
    above, so a matrix product over shared shingles decides nearly all pairs;
    those it leaves are verified exactly.
    """
    rows = group.select(["doc_id", "root", "role", "hashes", "weights"]).to_pylist()
    sides = [[r for r in rows if r["role"] == role] for role in (0, 1)]
    sets = [[(np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["weights"], "<f4")) for r in side] for side in sides]
    found: list[tuple[int, int]] = []
    if all(sets):
        flat = [np.concatenate([h for h, _ in side]) for side in sets]
        shared = np.intersect1d(*flat)
        entries = []
        for side, keys in zip(sets, flat, strict=True):
            at = np.searchsorted(shared, keys)
            known = at < len(shared)
            known[known] = shared[at[known]] == keys[known]
            owner = np.repeat(np.arange(len(side)), [len(h) for h, _ in side])
            root = np.sqrt(np.concatenate([w for _, w in side]))
            entries.append((at[known], owner[known], root[known]))
        bound = np.zeros((len(sets[0]), len(sets[1])), np.float32)
        for a in range(0, len(shared), SLAB):
            parts = []
            for (at, owner, root), side in zip(entries, sets, strict=True):
                here = (at >= a) & (at < a + SLAB)
                dense = np.zeros((len(side), min(SLAB, len(shared) - a)), np.float32)
                dense[owner[here], at[here] - a] = root[here]
                parts.append(dense)
            bound += parts[0] @ parts[1].T
        whole = [np.array([w.sum(dtype=np.float64) for _, w in side]) for side in sets]
        most = bound / np.maximum(whole[0][:, None] + whole[1][None] - bound, 1e-9)
        roots = [np.array([r["root"] for r in side]) for side in sides]
        may = (most >= threshold - 1e-3) & (roots[0][:, None] != roots[1][None])
        for x in np.flatnonzero(may.any(1)).tolist():
            done: set[int] = set()
            for y in sorted(np.flatnonzero(may[x]).tolist(), key=lambda y: -most[x, y]):
                other = int(roots[1][y])
                if other not in done and weighted_jaccard(*sets[0][x], *sets[1][y]) >= threshold - 1e-7:
                    done.add(other)
                    found.append((sides[0][x]["doc_id"], sides[1][y]["doc_id"]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def canopy_links(stars: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between texts of other roots that share a leader.

    A canopy is a leader's texts; every two texts of one bucket are in a canopy
    together.  Texts outside the canopy's largest root (x) meet all its texts
    (y), in tiles of about TILE of each, so no task grows with a canopy, and no
    pair becomes a row unless it is a link.
    """
    own = roots.select(F.col("node").alias("a"), "root")
    members = stars.join(own, "a", "left").select(F.col("b").alias("lead"), F.col("a").alias("doc_id"), F.coalesce("root", "a").alias("root"))
    sizes = members.groupBy("lead", "root").agg(F.count("*").alias("n"))
    canopies = sizes.groupBy("lead").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("largest"))
    mixed = canopies.filter("largest < n").select(
        "lead", "main", F.ceil(F.col("n") / TILE).cast("int").alias("ys"), F.ceil((F.col("n") - F.col("largest")) / TILE).cast("int").alias("xs")
    )
    # a leader may have a large share of all texts, so its texts are dealt to SALTS parts
    salted = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hashed = members.withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.shiftright("h", 32), F.lit(SALTS)).cast("int"))
    placed = hashed.join(salted, ["lead", "salt"])
    x = placed.filter("root <> main").withColumn("xt", F.pmod("h", F.col("xs"))).withColumn("yt", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)))
    y = placed.withColumn("yt", F.pmod("h", F.col("ys"))).withColumn("xt", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    columns = ["lead", F.col("xt").cast("int").alias("xt"), F.col("yt").cast("int").alias("yt"), "doc_id", "root"]
    both = x.select(*columns, F.lit(0).alias("role")).unionByName(y.select(*columns, F.lit(1).alias("role")))
    full = both.join(texts, "doc_id")
    return full.groupBy("lead", "xt", "yt").applyInArrow(lambda group: tile_links(group, threshold), "a long, b long")


def linked(texts: DataFrame, bands: DataFrame, threshold: float, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of nodes whose texts are linked with others; ``known`` are
    links (a, b) beside those of the texts.  A node may have several texts."""
    spark = texts.sparkSession
    leads = bands.groupBy("band_key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).filter("lead < last")
    shared = written(bands.join(leads.select("band_key", "lead"), "band_key"), "shared-bands")
    stars = written(shared.filter("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct(), "stars")
    none = spark.createDataFrame([], "node long, root long")

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose texts are not linked yet."""
        one = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        marked = pairs.join(one, "a", "left").join(two, "b", "left")
        return marked.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def grow(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Roots after further links: only classes that the links join are
        worked on, as edges between their roots."""
        held = written(links, f"{name}-links")
        edges = rooted(held, roots).filter("a <> b")
        release_shuffles(spark)
        moved = written(components(edges), f"{name}-moved")
        onto = moved.select(F.col("node").alias("root"), F.col("root").alias("onto"))
        kept = roots.join(onto, "root", "left").select("node", F.coalesce("onto", "root").alias("root"))
        return written(kept.unionByName(moved), f"{name}-roots")

    def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes as pairs of their roots."""
        one = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        both = pairs.join(one, "a", "left").join(two, "b", "left")
        return both.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))

    # each text with the least of its leaders, then with its other leaders where still apart
    first = stars.groupBy("a").agg(F.min("b").alias("b"))
    roots = grow(none, verified(first, texts, threshold), "first")
    others = written(apart(stars.join(first, ["a", "b"], "left_anti"), roots), "others")
    roots = grow(roots, verified(others, texts, threshold), "second")
    # what remains: texts that share a leader and are neither linked nor compared
    more = canopy_links(stars, roots, texts, threshold)
    if known is not None:
        more = more.unionByName(known)
    return grow(roots, more, "last")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
    bands: int = BANDS, rows: int = ROWS, idf_span: float = IDF_SPAN,
) -> DataFrame:
    """doc_id and class_id, the least id among the documents that near-duplicate
    links (weighted Jaccard of ``threshold`` or more) connect it to; a document
    without links is its own class.

    Words stand between ASCII white space, ASCII case folded.  A text of fewer
    than ``size`` words is one shingle of all its words; texts without words
    (null, empty, blank) are copies of each other.  Texts are compared whole.
    Rows without an id get no class; repeated rows are in one class, and so is
    what any text of a repeated id is linked to; an empty table gives no rows;
    other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    spark = docs.sparkSession
    rows_of = steady(text_rows(docs, id_col, text_col))
    with passing_tables(spark) as result:
        found = written(weighted_shingles(rows_of, rows_of.count(), bucket_count(rows_of), size, threshold, idf_span), "shingles")
        release_shuffles(spark)
        copies = written(found.groupBy("digest").agg(F.min("doc_id").alias("rep")), "copies")
        nodes = found.filter("n > 0").join(copies.select(F.col("rep").alias("doc_id"), F.col("digest").alias("d")), "doc_id")
        texts = written(nodes.filter("digest = d").dropDuplicates(["doc_id", "digest"]).select("doc_id", "hashes", "weights"), "texts")
        # an id with several texts links all that its texts link
        several = found.groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).filter("d1 <> d2").select("doc_id")
        own = found.join(several, "doc_id").join(copies, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        roots = linked(texts, written(band_keys(texts, bands, rows), "bands"), threshold, own.distinct())
        of_text = copies.join(roots, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("class_id"))
        classes = found.select("doc_id", "digest").join(of_text, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
        every = rows_of.select("doc_id").join(classes, "doc_id", "left")
        return result(every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the least of their class; rows without
    an id stay.  Of rows that repeat an id, one stays.  Columns may have any
    names; an empty table gives no rows."""
    gone = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("gone")).distinct()
    given = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    kept = given.join(gone, F.col("id") == F.col("gone"), "left_anti")
    if not given.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty():
        kept = kept.filter("id is not null").dropDuplicates(["id"]).unionByName(kept.filter("id is null"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
