"""Near-duplicate classes where one id has rows of different texts."""

import itertools

import pytest

from voxloom.llm import neardup

WORDS = {name: [name + str(k) for k in range(80)] for name in "abc"}


def text(name, edited=None):
    own = list(WORDS[name])
    if edited is not None:
        own[edited] = "edited"
    return " ".join(own)


@pytest.mark.parametrize("order", itertools.permutations("abc"))
def test_all_texts_of_an_id_count(spark, order):
    rows = [(1, text(n)) for n in order] + [(10 + k, text(n, 40)) for k, n in enumerate("abc")]
    rows += [(20 + k, text(n)) for k, n in enumerate("abc")] + [(30, "other words that stand alone here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicate_classes(frame).collect()
    assert {(r["doc_id"], r["class_id"]) for r in found} == {(i, 30 if i == 30 else 1) for i, _ in rows}


def test_an_id_links_classes_of_smaller_ids(spark):
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (9, text("b")), (10, text("b", 40)), (11, text("c")), (12, text("c", 40))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicate_classes(frame).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {3: 3, 5: 3, 9: 3, 10: 3, 11: 11, 12: 11}
