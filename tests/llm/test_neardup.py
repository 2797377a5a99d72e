"""Near-duplicate classes against brute force over all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxloom.llm import catalogue, neardup


def shingles(text):
    words = [w for w in re.split(r"[\t-\r ]+", text or "") if w]
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def brute(rows, threshold=0.8, span=0.1):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    n = len(rows)
    df = Counter(k for i, t in rows for k in shingles(t))
    idf = {k: 1 + span * np.log(n / v) / np.log(n) if n > 1 else 1 + span for k, v in df.items()}
    weights = {i: {k: v * idf[k] for k, v in s.items()} for i, s in sets.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, w in weights.items():
        for k in w:
            holders[k].append(i)
    pairs = {(i, j) for i, w in weights.items() for k in w for j in holders[k] if j < i}
    empty = [i for i, s in sets.items() if not s]
    for i, j in pairs | {(i, min(empty)) for i in empty}:
        a, b = weights[i], weights[j]
        both = sum(min(v, b.get(k, 0)) for k, v in a.items())
        union = sum(a.values()) + sum(b.values()) - both
        if not union or both / union >= threshold:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def classes(spark, table, **options):
    frame = spark.createDataFrame(table, "doc_id long, text string")
    found = neardup.near_duplicate_classes(frame, **options).collect()
    assert len(found) == len(table)
    return {r["doc_id"]: r["class_id"] for r in found}


def corpus():
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(5000))
    rows = []
    for base in range(6):
        text = [word() for _ in range(rng.randrange(60, 300))]
        for k in range(12):
            own = list(text)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = word()
            rows.append((base * 100 + k, " ".join(own)))
    passage = " ".join(word() for _ in range(40))
    rows += [(1000 + k, passage + " " + " ".join(word() for _ in range(rng.randrange(20, 60)))) for k in range(20)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one two"), (2004, "One  TWO"), (2005, "one three"), (2006, "x " * 400), (2007, "x " * 395)]
    return rows


def test_classes(spark):
    rows = corpus()
    wanted = brute(rows)
    assert classes(spark, rows) == wanted
    assert wanted[2004] == 2003 and wanted[2005] == 2005 and wanted[2002] == 2000


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["class_id"] for r in catalogue.op4_near_duplicates(spark, sf_dir).collect()}
    assert found == brute(rows)


def test_no_id_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "q r s t u v"), (3, "q r s t u v"), (4, "q r s t u v")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, neardup.near_duplicate_classes(frame).collect()), key=str)
    assert found == sorted([(None, None), (None, None), (3, 3), (3, 3), (4, 3)], key=str)
    assert neardup.near_duplicate_classes(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicate_classes(frame, threshold=0)
    kept = neardup.one_of_each(frame, neardup.near_duplicate_classes(frame))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 3]


def test_cross_pairs_of_mixed_buckets(spark, monkeypatch):
    """Bands of one sample: most buckets hold several classes, in tiny tiles."""
    monkeypatch.setattr(neardup, "TILE", 3)
    monkeypatch.setattr(neardup, "SLAB", 50)
    rows = corpus()
    loose = classes(spark, rows, bands=40, rows=1)
    assert loose == brute(rows)


def test_dense_group_is_decided_whole(spark):
    """Copies so edited that many reach the threshold only with each other."""
    rng = random.Random(8)
    base = ["b" + str(k) for k in range(150)]
    rows = []
    for k in range(120):
        own = list(base)
        for _ in range(rng.randrange(2, 7)):
            at = rng.randrange(0, 150, 10)
            own[at] = f"e{at}"
        rows.append((k, " ".join(own)))
    assert classes(spark, rows) == brute(rows)


def test_sampling_estimates_the_similarity():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    w = (rng.random(500) + 0.2).astype("<f4")
    v = w.copy()
    v[::3] *= 2
    wanted = neardup.weighted_jaccard(h[:450], w[:450], h[50:], v[50:])
    a, b = neardup.icws(h[:450], w[:450], 3000), neardup.icws(h[50:], v[50:], 3000)
    assert abs((a == b).mean() - wanted) < 0.03
    both = sum(min(x, y) for x, y in zip(w[50:450].tolist(), v[50:450].tolist(), strict=True))
    assert wanted == pytest.approx(both / (w[:450].sum() + v[50:].sum() - both), abs=1e-6)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (102, 101), (200, 200)] + [(300, rng.randrange(301, 330)) for _ in range(60)]
    found = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(1, 31)) and 0 not in found and {found[k] for k in (101, 102)} == {100} and 200 not in found
    assert all(found[b] == 300 for a, b in edges if a == 300)
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
