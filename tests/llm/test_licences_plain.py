"""Licence scans against a plain version that shares no code, and hard cases."""

import math
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import licences
from voxloom.llm.common import byte_buffers

MODEL = licences.train()
SCANNER = licences.Scanner(MODEL)


def plain_words(text):
    out = []
    for w in re.split(r"[^a-z0-9]+", "".join(c.lower() if c.isascii() else " " for c in text)):
        m = re.match(r"^(gpl|lgpl)(v\d\w*)$", w)
        out += [m[1], m[2]] if m else [w] if w else []
    return out


def plain_probabilities(tokens):
    seen = set()
    for a in range(len(tokens)):
        for b in range(a + 1, min(a + 3, len(tokens)) + 1):
            seen.add(" ".join(tokens[a:b]))
    logits = [float(x) for x in MODEL.bias]
    for gram in seen:
        if gram in MODEL.features:
            for k, w in enumerate(MODEL.weights[MODEL.features[gram]]):
                logits[k] += float(w)
    e = [math.exp((x - max(logits)) / MODEL.temperature) for x in logits]
    return [x / sum(e) for x in e]


def plain_match(tokens, family):
    """Word pairs matched, first word and end of the best template or name."""
    found = []
    for name in [*licences.NAMES[family], *(t for t in licences.TEMPLATES[family] if t.startswith("SPDX"))]:
        name = plain_words(name)
        places = [k for k in range(len(tokens)) if tokens[k : k + len(name)] == name]
        if places:
            found.append((len(name) - 1, places[0] - len(tokens), places[0], places[0] + len(name)))
    here = [(a, b) for a, b in zip(tokens, tokens[1:])]
    for template in licences.TEMPLATES[family]:
        if template.startswith("SPDX"):
            continue
        own = plain_words(template)
        pairs = set(zip(own, own[1:]))
        wanted = pairs & set(here)
        if not wanted or len(wanted) / len(pairs) < licences.COVERAGE:
            continue
        spans = []
        for end in range(len(here)):
            left = next((a for a in range(end, -1, -1) if wanted <= set(here[a : end + 1])), None)
            if left is not None:
                spans.append((end + 2 - left, left, end + 2))
        size, first, end = min(spans)
        found.append((len(wanted), -size, first, end))
    if not found:
        return None
    n, _, first, end = max(found)
    return n, first, end


def plain_segment(tokens, before):
    p = plain_probabilities(tokens)
    best = p.index(max(p))
    if best == 0 or p[best] < licences.CONFIDENCE:
        return None
    family = MODEL.families[best]
    match = plain_match(tokens, family)
    if not match or any(w in licences.DENYING for w in (before + tokens[: match[1]])[-4:]):
        return None
    return *match, family


def plain_paragraphs(text):
    """Line number among visible lines, and family, of every notice."""
    found, number, run = [], 0, []
    for line in [*text.split("\n"), ""]:
        if line.strip(" \t\n\r\f\v"):
            run.append(line)
            continue
        tokens, owner, cuts = [], [], [0]
        for k, x in enumerate(run):
            tokens += plain_words(x)
            owner += [k] * len(plain_words(x))
            cuts.append(len(tokens))
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a] + ([(0, len(tokens))] if len(set(owner)) > 1 else [])
        hits = []
        for a, b in spans:
            at = a
            while True:
                end = min(b, at + licences.WINDOW)
                hit = plain_segment(tokens[at:end], tokens[max(0, at - 4) : at])
                if hit:
                    hits.append((hit[0], at + hit[1], at + hit[2], hit[3]))
                if end == b:
                    break
                at += licences.STEP
        used, own = set(), set()
        for n, first, end, family in sorted(hits, key=lambda h: -h[0]):
            if used.isdisjoint(range(first, end)):
                used |= set(range(first, end))
                own.add((number + owner[first], family))
        found += sorted(own)
        number += len(run)
        run = []
    return found


def scanned(texts):
    block = licences.Block(*byte_buffers(pa.array(texts)))
    before = [int(block.visible[block.text_of_line < k].sum()) for k in range(len(texts))]
    found = [[] for _ in texts]
    for line, family, _ in SCANNER.notices(block, licences.CONFIDENCE, licences.COVERAGE):
        text = int(block.text_of_line[line])
        found[text].append((int(block.visible[:line].sum()) - before[text], family))
    return found


PIECES = [
    "Licensed under the Apache License, Version 2.0", "Released under the MIT License", "not", "SPDX-License-Identifier: MIT", "GPLv3", "xgplv3", "lgplv2.1",
    "\n", "\n\n", " ", "\t\n", "é", "the K and", "words of a story", "you may not use this file except in compliance with the License", "Licensed under CC BY-SA 4.0",
    "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public License", "GPLv", "0", "_",
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software", "word " * 50,
]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=10).map(" ".join), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_blocks_against_the_plain_version(texts):
    assert scanned(texts) == [plain_paragraphs(t) for t in texts]


def test_documents_against_the_plain_version(spark, sf_dir):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    assert scanned(texts) == [plain_paragraphs(t) for t in texts]
    assert any(scanned(texts))


@pytest.mark.parametrize("text, family", [
    ("SPDX_License_Identifier: MIT", "MIT"), ("Released under the MIT_License", "MIT"), ("Released under the MIT licence", "MIT"),
    ("SPDX-License-Identifier: EPL-2.0", "unknown"), ("SPDX-License-Identifier: AGPL-3.0-only", "unknown"),
    ("GNU Affero General Public License, version 3", "unknown"), ("not licensed under the MIT License", "unknown"),
    ("This library was never released under the GPL v3", "unknown"), ("The code is no longer licensed under the Apache License, Version 2.0", "unknown"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose", "unknown"),
])
def test_hard_cases(text, family):
    assert MODEL.classify(text)[0] == family
    assert [f for _, f in scanned([text])[0]] == ([family] if family != "unknown" else [])


def test_nothing_chooses_what_the_classifier_sees():
    """Every line with a word is a segment, whatever the word."""
    texts = ["zebra\n\nmagnolia quartz", "", "é\n--\n7"]
    block = licences.Block(*byte_buffers(pa.array(texts)))
    begin, end = block.segments()
    assert [block.tokens(a, b) for a, b in zip(begin, end)] == [["zebra"], ["magnolia", "quartz"], ["7"]]


def test_calibration_on_unseen_notices():
    assert 0 < MODEL.calibration_error < 0.2
