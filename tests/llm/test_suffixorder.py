"""The global suffix order against a dictionary of all strings."""

import random

from voxloom.llm.suffixdedup import cut_repeats
from voxloom.llm.suffixorder import repeated_starts, suffix_ranks, symbols

SCHEMA = "doc_id long, text string, s string, p int"


def brute(rows, length):
    places = {}
    every = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            key = (-(1 << 63) if doc_id is None else doc_id, p)
            every.append((doc_id, p, key, raw[p : p + length]))
            places[raw[p : p + length]] = min(key, places.get(raw[p : p + length], key))
    return sorted(((d, p) for d, p, key, x in every if key > places[x]), key=str)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def test_ranks_are_the_order_of_the_suffixes(spark):
    random.seed(3)
    texts = ["".join(random.choice("ab") for _ in range(n)) for n in (0, 1, 2, 3, 20, 41)] + ["abababababab"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "s long, text string")
    found = sorted(suffix_ranks(symbols(df), 1, 27, 4).collect(), key=lambda r: r.r)
    assert len(found) == sum(map(len, texts))
    ordered = [texts[r.s][r.p :] for r in found]
    assert ordered == sorted(ordered)


def test_awkward_rows(spark):
    random.seed(5)
    passage = "".join(random.choice("xyz é") for _ in range(140))
    run = "a" * 330
    rows = [(4, "start " + passage + " end"), (2, passage), (2, passage), (None, passage[:120]), (7, None), (8, ""), (9, run), (1, "b" + run), (3, "short")]
    rows += [(20 + k, passage[k:] + str(k)) for k in range(6)]
    found = sorted(((r.doc_id, r.start) for r in repeated_starts(table(spark, rows), 80).collect()), key=str)
    assert found == brute(rows, 80)
    covered = {}
    for doc_id, start in found:
        covered.setdefault(doc_id, set()).update(range(start, start + 80))
    unique = [r for r in rows if r[0] != 2]  # of a repeated id the cuts are by row
    cuts = [r for r in cut_repeats(table(spark, rows), 80, keep_text=False).collect() if r.doc_id != 2]
    assert {r.doc_id: r.n_removed for r in cuts} == {k: len(covered.get(k, ())) for k, _ in unique}


def test_empty(spark):
    assert repeated_starts(table(spark, []), 100).collect() == []
