"""Licence scans: held-out variants, unknowns, whole texts."""

import numpy as np
import pytest

from voxloom.llm import catalogue, licences

MODEL = licences.train()


def test_held_out_variants():
    rng = np.random.default_rng(99)
    right = total = 0
    for family, notices in licences.TEMPLATES.items():
        for notice in notices:
            for tokens in list(licences.variants(notice, 8, rng))[1:]:
                right += MODEL.families[int(np.argmax(MODEL.probabilities(tokens)))] == family
                total += 1
    assert right / total > 0.9


@pytest.mark.parametrize("text, family", [
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    ("LICENSED UNDER THE BSD 3-CLAUSE LICENSE.", "BSD"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
])
def test_families(text, family):
    assert MODEL.classify(text)[0] == family


@pytest.mark.parametrize("text", ["", "plain words", "the license plate", "A fishing licence", "license", "All rights reserved. Licensed under our own license."])
def test_unknown(text):
    assert MODEL.classify(text)[0] == licences.UNKNOWN


def test_templates_confirm():
    assert licences.covered(licences.words("apache license"), "Apache-2.0") < 0.6
    assert licences.covered(licences.words("x Licensed under CC BY 4.0 y"), "CC-BY") == 1.0


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(5)
    sure = [MODEL.probabilities(t).max() for n in licences.ORDINARY for t in licences.variants(n, 4, rng)]
    assert 0.5 < np.mean(sure) <= 1 and MODEL.temperature > 0
    assert MODEL.probabilities([]).argmax() == 0


def plain_scan(text):
    own, at, number = [], 0, -1
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\f\v"):
            number += 1
            family, _ = MODEL.classify(line)
            if family != licences.UNKNOWN:
                own.append((number, at, family))
        at += len(line) + 1
    return number + 1, own


def test_scan(spark):
    rows = [(1, "x\n\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (2, None), (3, ""), (4, "é\n \n" + "word " * 50_000 + "\nReleased under the MIT License."), (None, "license")]
    found = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for row in found:
        n, own = plain_scan(texts[row["doc_id"]])
        assert row["n_paragraphs"] == n and row["n_licence"] == len(own)
        assert [(f["paragraph"], f["start"], f["family"]) for f in row["found"]] == own
    assert {r["doc_id"]: r["families"] for r in found} == {1: "Apache-2.0:1,MIT:1", 2: "", 3: "", 4: "MIT:1", None: ""}
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in catalogue.op7_licences(spark, sf_dir).collect():
        n, own = plain_scan(texts[row["doc_id"]])
        assert (row["n_paragraphs"], row["n_licence"]) == (n, len(own))
