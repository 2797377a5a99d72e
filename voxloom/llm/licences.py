"""Licence scans: a trained paragraph classifier confirmed by templates.

Families are told apart by a multinomial logistic regression over sparse word
1- to 3-grams, trained on variants of each family's notices and texts, and for
the class "unknown" on ordinary sentences that use the same words, notices of
families that are not told apart, and denials.  Its probabilities are calibrated
by a temperature fitted on notices that a first fit has not seen; a text below
the confidence is unknown.  A family stands only if the text also covers enough
of one of that family's templates, or holds one of its exact names, and no word
shortly before denies it.

Every line is classified, long ones in windows of words, and for notices that
are wrapped so are windows over the lines between two blank ones.  That is done
for a block of texts at once: words and n-grams are hashed, n-grams that are
features are found in a sorted list, and weights are added up by segment.  Only
segments that reach the confidence are looked at as words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import blocks, byte_buffers, ragged, text_rows
from voxloom.llm.hashing import mix, span_hashes

UNKNOWN = "unknown"
#: Notices by which licence families are known.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the terms of the Apache Software License 2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL license, version 2",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC0": (
        "Released into the public domain under CC0 1.0",
        "To the extent possible under law, the author has waived all copyright under Creative Commons CC0",
    ),
}
#: Versions that Creative Commons names end with.
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Short names and SPDX identifiers, which count only word for word.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License", "MIT Licence", "License: MIT"),
    "GPL": (
        "GNU General Public License", "GNU General Public Licence", "GNU GPL", "GPL v2", "GPL v3",
        *(f"SPDX-License-Identifier: GPL-{v}" for v in ("1.0", "2.0", "3.0")),
    ),
    "LGPL": (
        "GNU Lesser General Public License", "GNU Library General Public License", "GNU Lesser General Public Licence", "GNU LGPL",
        "LGPL v2", "LGPL v3", *(f"SPDX-License-Identifier: LGPL-{v}" for v in ("2.0", "2.1", "3.0")),
    ),
    "BSD": (
        "BSD License", "BSD 3-Clause", "BSD 2-Clause", "3-Clause BSD License", "2-Clause BSD License",
        *(f"SPDX-License-Identifier: BSD-{k}-Clause" for k in (1, 2, 3, 4)),
    ),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    **{
        family: tuple(
            name for v in CC_VERSIONS
            for name in (f"Creative Commons {long} {v}", f"CC {short} {v}", f"SPDX-License-Identifier: CC-{short}-{v}")
        )
        for family, long, short in (
            ("CC-BY", "Attribution", "BY"), ("CC-BY-SA", "Attribution-ShareAlike", "BY-SA"), ("CC-BY-NC", "Attribution-NonCommercial", "BY-NC"),
        )
    },
    "CC0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "SPDX-License-Identifier: CC0-1.0"),
}
#: Standard texts of the families, which train the classifier beside the templates.
PARAGRAPHS = {
    "Apache-2.0": (
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    "MIT": (
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL": (
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "BSD": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ),
    "MPL-2.0": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC-BY": ("To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",),
    "CC-BY-SA": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",),
    "CC-BY-NC": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",),
    "CC0": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the "
        "work worldwide under copyright law",
        "http://creativecommons.org/publicdomain/zero/1.0/",
    ),
}
#: Notices of families that are not told apart, and texts that name a family to deny it.
OTHERS = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "GNU Affero General Public License", "GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only",
    "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU AGPL v3",
    "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License 2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "SPDX-License-Identifier: ISC", "Licensed under the ISC License",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: 0BSD",
    "This is free and unencumbered software released into the public domain", "Released under the Unlicense",
    "SPDX-License-Identifier: CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "Licensed under CC BY-ND 4.0",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Licensed under CC BY-NC-SA 4.0",
    "Licensed under the Boost Software License, Version 1.0", "Released under the Artistic License 2.0",
    "This software is provided 'as-is', without any express or implied warranty",
    "SPDX-License-Identifier: LicenseRef-Proprietary", "This file is confidential and proprietary; all rights reserved",
)
DENIALS = ("not", "never", "not be", "no longer", "neither")
#: Sentences that use the words and name no family.
ORDINARY = (
    "The driver had no license and the police released him",
    "A fishing licence is needed under the law of the land",
    "She holds a license to practise medicine in the state",
    "All copyright belongs to the authors of the work",
    "The terms of the software license were never published",
    "He took poetic license with the public record",
    "The apache helicopter landed near the public road",
    "Permission was granted by the general to use the road",
    "The mozilla foundation and the gnu project met in public",
    "Creative people share the commons and their work",
    "Licensed under a proprietary license, all rights reserved",
    "Redistribution of income was modified by the new law",
    "The license plate was found in the source of the river",
    "Copyright notice: this license is granted by the company",
)
#: Words that, shortly before a notice, deny it.
DENYING = frozenset(("not", "never", "nor", "neither", "longer", "isn", "wasn", "aren", "cannot"))
WORDS = re.compile(r"[A-Za-z0-9]+")
JOINED = re.compile(r"(l?gpl)(v[0-9].*)")
CONFIDENCE, COVERAGE = 0.5, 0.6
#: Words of a window and from one to the next: a template lies whole in one.
WINDOW, STEP = 32, 8
#: Words before a notice in which a denial counts.
BEFORE = 4
#: Step and momentum of the gradient descent.
RATE, MOMENTUM = 8.0, 0.9
#: Times a short name counts among the examples.
NAME_COPIES = 6
GRAMS = 3
#: Bits of the table that tells most n-grams that are no feature.
SIEVE_BITS = 20
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
BLANK_BYTE = np.zeros(256, bool)
BLANK_BYTE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def words(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower case; GPLv3 and the like are two."""
    found = []
    for word in WORDS.findall(text):
        split = JOINED.fullmatch(word.lower())
        found += split.groups() if split else [word.lower()]
    return found


def grams(tokens: list[str]) -> set[str]:
    """1-, 2- and 3-grams."""
    return {" ".join(tokens[a : a + n]) for n in range(1, GRAMS + 1) for a in range(len(tokens) - n + 1)}


def variants(text: str, n: int, rng: np.random.Generator) -> Iterator[list[str]]:
    """The words of a notice, whole and with words lost or put around it."""
    own = words(text)
    yield own
    fill = [w for s in ORDINARY for w in words(s)]
    fill = [w for w in fill if w not in NAMING and w not in DENYING]
    for _ in range(n):
        kept = [w for w in own if rng.random() > 0.1]
        before = [str(w) for w in rng.choice(fill, rng.integers(0, 6))]
        after = [str(w) for w in rng.choice(fill, rng.integers(0, 12))]
        yield before + kept + after


#: Words of the families' names: variants put none of them, and none that denies, beside a notice.
NAMING = frozenset(w for texts in (*TEMPLATES.values(), *NAMES.values()) for t in texts for w in words(t)) | {"copyright", "copyrighted", "licenses"}


@dataclass
class LicenceModel:
    """Weights of each feature, biases, the temperature, and the error of the
    calibration on notices that took no part in the training it is taken from."""

    families: list[str]
    features: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    calibration_error: float = 0.0

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        own = [self.features[g] for g in grams(tokens) if g in self.features]
        return softmax((self.bias + self.weights[own].sum(0)) / self.temperature)

    def confirmed(self, tokens: list[str], before: list[str], confidence: float, coverage: float) -> tuple[int, int, int, str, float] | None:
        """Pairs matched, first word, end, family and probability of the notice
        that a segment is predicted to be, if templates confirm it and none of
        the words shortly before it denies it."""
        p = self.probabilities(tokens)
        best = int(np.argmax(p))
        family = self.families[best]
        if family == UNKNOWN or p[best] < confidence:
            return None
        match = stretch(tokens, family, coverage)
        if match is None or not DENYING.isdisjoint([*before, *tokens[: match[1]]][-BEFORE:]):
            return None
        return *match, family, float(p[best])

    def classify(self, paragraph: str, confidence: float = CONFIDENCE, coverage: float = COVERAGE) -> tuple[str, float]:
        """The family and its probability; ("unknown", ...) where no family
        reaches the confidence or no template of it is covered.  Of a text
        longer than a window, the window that matches the most word pairs."""
        tokens, found, unknown = words(paragraph), [], []
        for a, b in windows(len(tokens)):
            match = self.confirmed(tokens[a:b], tokens[max(0, a - BEFORE) : a], confidence, coverage)
            if match:
                found.append((match[0], match[4], match[3]))
            else:
                unknown.append(float(self.probabilities(tokens[a:b])[self.families.index(UNKNOWN)]))
        if not found:
            return UNKNOWN, min(unknown)
        _, p, family = max(found)
        return family, p

    def notices(self, lines: list[str], confidence: float = CONFIDENCE, coverage: float = COVERAGE) -> list[tuple[int, str, float]]:
        """Line, family and probability of the notices in lines without a blank
        one between, by the line they begin in; one a line and family.

        Every line, in windows if it is long, and every window over the words of
        all lines is a segment, classified and confirmed.  Of notices that share
        words, the one that matches the most word pairs stands.
        """
        tokens, owner, cuts = [], [], [0]
        for k, line in enumerate(lines):
            own = words(line)
            tokens += own
            owner += [k] * len(own)
            cuts.append(len(tokens))
        segments = [(a + x, a + y) for a, b in zip(cuts, cuts[1:], strict=False) if b > a for x, y in windows(b - a)]
        if len(set(owner)) > 1:
            segments += windows(len(tokens))
        return self.standing(tokens, segments, owner, confidence, coverage)

    def standing(self, tokens: list[str], segments: list[tuple[int, int]], owner: list[int], confidence: float, coverage: float) -> list[tuple[int, str, float]]:
        """Owner (line) of the first word, family and probability of what stands
        of the segments' notices, in order; one for each owner and family."""
        found = []
        for a, b in segments:
            match = self.confirmed(tokens[a:b], tokens[max(0, a - BEFORE) : a], confidence, coverage)
            if match:
                n, first, end, family, p = match
                found.append((-n, a + first, a + end, family, p))
        taken, kept = np.zeros(len(tokens), bool), {}
        for _, first, end, family, p in sorted(found, key=lambda x: x[0]):  # stable: lines alone come first
            if not taken[first:end].any():
                taken[first:end] = True
                kept.setdefault((owner[first], family), p)
        return sorted((line, family, p) for (line, family), p in kept.items())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def windows(n: int) -> list[tuple[int, int]]:
    """Windows over n words; the first of a short text is all of it."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - WINDOW + STEP), STEP)]


def pairs(tokens: list[str]) -> set[tuple[str, str]]:
    return set(zip(tokens, tokens[1:], strict=False))


#: Of each family the word pairs of its templates and the words of its exact names.
PAIRS = {family: [pairs(words(t)) for t in texts if not t.startswith("SPDX")] for family, texts in TEMPLATES.items()}
EXACT = {
    family: [words(t) for t in (*NAMES[family], *(t for t in texts if t.startswith("SPDX")))] for family, texts in TEMPLATES.items()
}


def exact(tokens: list[str], name: list[str]) -> int:
    """Where a name stands in a text word for word; -1 where it does not."""
    n = len(name)
    return next((k for k in range(len(tokens) - n + 1) if tokens[k] == name[0] and tokens[k : k + n] == name), -1)


def covered(tokens: list[str], family: str) -> float:
    """The largest share of a template's word pairs that stand in a paragraph;
    1 where it holds one of the exact names."""
    if any(exact(tokens, name) >= 0 for name in EXACT[family]):
        return 1.0
    own = pairs(tokens)
    return max(len(t & own) / max(1, len(t)) for t in PAIRS[family])


def stretch(tokens: list[str], family: str, coverage: float) -> tuple[int, int, int] | None:
    """Pairs matched, first word and end of the shortest stretch that holds all
    word pairs of the family's best matched template or name, if covered."""
    found = []
    for name in EXACT[family]:
        at = exact(tokens, name)
        if at >= 0:
            found.append((len(name) - 1, at - len(tokens), at, at + len(name)))
    places = list(zip(tokens, tokens[1:], strict=False))
    own = set(places)
    for template in PAIRS[family]:
        wanted = template & own
        if not wanted or len(wanted) / len(template) < coverage:
            continue
        last: dict[tuple[str, str], int] = {}
        best = (len(tokens) + 1, 0, 0)
        for k, pair in enumerate(places):
            if pair in wanted:
                last.pop(pair, None)
                last[pair] = k  # in the order last seen
                if len(last) == len(wanted):
                    first = next(iter(last.values()))
                    best = min(best, (k + 2 - first, first, k + 2))
        found.append((len(wanted), -best[0], best[1], best[2]))
    if not found:
        return None
    n, _, first, end = max(found)
    return n, first, end


class Sparse:
    """Rows of feature sets: products with dense matrices from sorted entries."""

    def __init__(self, rows: list[list[int]], n_features: int):
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        feature = np.array([k for r in rows for k in r], np.int64)
        self.shape = (len(rows), n_features)
        self.by_row, self.row = feature, row
        order = np.argsort(feature, kind="stable")
        self.by_feature, self.feature = row[order], feature[order]

    @staticmethod
    def sums(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, values.shape[1]))
        if len(keys):
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            out[keys[heads]] = np.add.reduceat(values, heads)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.sums(w[self.by_row], self.row, self.shape[0])

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        return self.sums(e[self.by_feature], self.feature, self.shape[1])


def examples(keep: Callable[[int], bool], per_notice: int, seed: int) -> list[tuple[list[str], int]]:
    """Words and class of variants of the notices whose number ``keep`` takes."""
    rng = np.random.default_rng(seed)
    found = []
    sources = [(0, t) for t in (*ORDINARY, *OTHERS)]
    sources += [(label, t) for label, family in enumerate(TEMPLATES, 1) for t in (*TEMPLATES[family], *PARAGRAPHS[family])]
    numbers = {}
    for label, text in sources:
        numbers[label] = numbers.get(label, -1) + 1
        own = list(variants(text, per_notice, rng))
        if keep(numbers[label]):
            found += [(tokens, label) for tokens in own]
    for label, family in enumerate(NAMES, 1):  # word for word
        found += [(tokens, label) for k, name in enumerate(NAMES[family]) if keep(k) for tokens in [words(name)] * NAME_COPIES]
        for k, text in enumerate((*NAMES[family], *TEMPLATES[family])):
            if keep(k):
                denial = words(DENIALS[int(rng.integers(len(DENIALS)))])
                cut = next((j for j, w in enumerate(words(text)) if w in ("licensed", "released")), 0)
                lead = [] if cut or words(text)[0] in ("licensed", "released") else ["licensed", "under", "the"]
                found.append((words(text)[:cut] + denial + lead + words(text)[cut:], 0))
    fill = [w for s in ORDINARY for w in words(s)]
    for _ in range(40 * per_notice // 4):  # words in no order, and none at all
        found.append(([str(w) for w in rng.choice(fill, rng.integers(0, 8))], 0))
    return found


def fitted(rows: list[tuple[list[str], int]], families: list[str], rounds: int, penalty: float) -> LicenceModel:
    features = {g: k for k, g in enumerate(sorted({g for tokens, _ in rows for g in grams(tokens)}))}
    x = Sparse([sorted(features[g] for g in grams(tokens)) for tokens, _ in rows], len(features))
    y = np.eye(len(families))[[label for _, label in rows]]
    w, b = np.zeros((len(features), len(families))), np.zeros(len(families))
    step_w, step_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        error = (softmax(x.times(w) + b) - y) / len(rows)
        step_w = MOMENTUM * step_w - RATE * (x.transposed_times(error) + penalty * w)
        step_b = MOMENTUM * step_b - RATE / 8 * error.sum(0)
        w, b = w + step_w, b + step_b
    return LicenceModel(families, features, w, b, 1.0)


def calibration_error(p: np.ndarray, truth: np.ndarray, bins: int = 10) -> float:
    """The mean gap of confidence and accuracy over ten bins of confidence."""
    sure, right = p.max(1), p.argmax(1) == truth
    which = np.minimum((sure * bins).astype(int), bins - 1)
    return float(sum(abs(sure[which == k].mean() - right[which == k].mean()) * (which == k).mean() for k in np.unique(which)))


@cache
def train(seed: int = 7, per_notice: int = 32, rounds: int = 300, penalty: float = 3e-4) -> LicenceModel:
    """Fits the classifier on variants of all notices.

    The temperature comes from notices that a first fit has not seen: every
    third of each family's and of the unknown class's is kept from it.
    """
    families = [UNKNOWN, *TEMPLATES]
    first = fitted(examples(lambda k: k % 3 != 2, per_notice, seed), families, rounds, penalty)
    unseen = examples(lambda k: k % 3 == 2, per_notice, seed + 1)
    logits = np.array([first.bias + first.weights[[first.features[g] for g in grams(t) if g in first.features]].sum(0) for t, _ in unseen])
    truth = np.array([label for _, label in unseen])
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.25, 8, 41)}
    model = fitted(examples(lambda k: True, per_notice, seed), families, rounds, penalty)
    model.temperature = float(min(losses, key=losses.get))
    model.calibration_error = calibration_error(softmax(logits / model.temperature), truth)
    return model


# --- whole blocks of texts at a time


class Block:
    """Lines, words and paragraphs of a block of texts, as arrays."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = FOLD[data], offsets
        after = np.flatnonzero(data == 10) + 1
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        #: where lines begin; an empty last line of a text is left out, as it is blank
        self.lines = np.union1d(after[after < len(data)], filled)
        line_ends = np.append(self.lines[1:], len(data))
        visible = np.concatenate([[0], np.cumsum(~BLANK_BYTE[data], dtype=np.int64)])
        self.visible = visible[line_ends] > visible[self.lines] if len(self.lines) else np.zeros(0, bool)
        self.text_of_line = np.searchsorted(offsets, self.lines, "right") - 1
        joined = np.zeros(len(self.lines), bool)
        joined[1:] = self.visible[1:] & self.visible[:-1] & (self.text_of_line[1:] == self.text_of_line[:-1])
        self.run_of_line = np.cumsum(~joined) - 1
        self.starts, self.ends = self.word_spans()
        self.line_of_word = np.searchsorted(self.lines, self.starts, "right") - 1

    def word_spans(self) -> tuple[np.ndarray, np.ndarray]:
        inside = WORD_BYTE[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        raw, cuts, at = self.data.tobytes(), [], -1
        while (at := raw.find(b"gplv", at + 1)) >= 0:  # GPLv3 and the like are two words
            k = int(np.searchsorted(starts, at, "right")) - 1
            begins = k >= 0 and (starts[k] == at or starts[k] == at - 1 and raw[at - 1 : at] == b"l")
            if begins and at + 4 < ends[k] and raw[at + 4 : at + 5].isdigit():
                cuts.append(at + 3)
        return np.union1d(starts, cuts).astype(np.int64), np.union1d(ends, cuts).astype(np.int64)

    def tokens(self, a: int, b: int) -> list[str]:
        return [self.data[s:e].tobytes().decode() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of every segment: lines, then paragraphs of
        several lines, each in windows."""
        n = len(self.starts)
        heads = np.flatnonzero(np.diff(self.line_of_word, prepend=-1)) if n else np.zeros(0, np.int64)
        tails = np.append(heads[1:], n)[: len(heads)]
        run = self.run_of_line[self.line_of_word[heads]] if n else heads
        first = np.flatnonzero(np.diff(run, prepend=-1)) if n else heads
        last = np.append(first[1:], len(heads))[: len(first)] - 1
        many = last > first
        a = np.concatenate([heads, heads[first[many]]])
        b = np.concatenate([tails, tails[last[many]]])
        n_windows = np.maximum(1, -(-(b - a - WINDOW + STEP) // STEP))
        begin = np.repeat(a, n_windows) + STEP * ragged(np.zeros(len(a), np.int64), n_windows)
        return begin, np.minimum(begin + WINDOW, np.repeat(b, n_windows))


def gram_hashes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the 1-, 2- and 3-grams from each word on."""
    g = mix(hashes)
    yield g
    for n in range(1, GRAMS):
        g = mix(g[: max(0, len(hashes) - n)] + hashes[n:])
        yield g


class Scanner:
    """The classifier over all segments of a block at once."""

    def __init__(self, model: LicenceModel):
        self.model = model
        names = list(model.features)
        spelled = [n.encode() for n in names]
        data = np.frombuffer(b" ".join(spelled), np.uint8)
        inside = WORD_BYTE[data]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        sizes = np.array([n.count(" ") + 1 for n in names])
        first = np.cumsum(sizes) - sizes
        per_size = list(gram_hashes(span_hashes(data, starts, ends)))
        hashes = np.array([per_size[k - 1][at] for k, at in zip(sizes.tolist(), first.tolist(), strict=True)], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.weights = model.weights[[model.features[names[k]] for k in order]]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.hashes >> np.uint64(64 - SIEVE_BITS)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams that are features, and which."""
        at = np.flatnonzero(self.sieve[g >> np.uint64(64 - SIEVE_BITS)])
        found = np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)
        real = self.hashes[found] == g[at]
        return at[real], found[real]

    def chosen(self, block: Block, confidence: float) -> tuple[np.ndarray, np.ndarray]:
        """Segments of which a family reaches the confidence."""
        begin, end = block.segments()
        places, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, g in enumerate(gram_hashes(span_hashes(block.data, block.starts, block.ends)), 1):
            at, which = self.hits(g)
            low, high = np.searchsorted(at, begin), np.searchsorted(at, end - n, "right")
            counts = np.maximum(high - low, 0)
            places.append(np.repeat(np.arange(len(begin)), counts))
            features.append(which[ragged(low, counts)])
        pairs = np.unique(np.concatenate(places) * len(self.hashes) + np.concatenate(features))
        owner = pairs // len(self.hashes)
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        logits = np.add.reduceat(self.weights[pairs % len(self.hashes)], heads) if len(heads) else np.zeros((0, len(self.model.bias)))
        p = softmax((logits + self.model.bias) / self.model.temperature)
        # a margin for sums in another order; ``confirmed`` decides
        which = owner[heads[(p[:, 1:].max(1, initial=0) >= confidence - 1e-6)]]
        return begin[which], end[which]

    def notices(self, block: Block, confidence: float, coverage: float) -> list[tuple[int, str, float]]:
        """Line of the block, family and probability of every notice."""
        begin, end = self.chosen(block, confidence)
        run = block.run_of_line[block.line_of_word[begin]] if len(begin) else begin
        found = []
        for r in np.unique(run):
            own = np.flatnonzero(run == r)
            lines = np.searchsorted(block.run_of_line, [r, r + 1])
            a, b = np.searchsorted(block.line_of_word, lines)
            tokens, owner = block.tokens(a, b), block.line_of_word[a:b].tolist()
            segments = [(int(x - a), int(y - a)) for x, y in zip(begin[own], end[own], strict=True)]
            found += self.model.standing(tokens, segments, owner, confidence, coverage)
        return found


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_paragraphs, n_licence, families ("name:paragraphs", by name,
    joined by commas) and found (paragraph number, start, family, probability).

    Paragraphs are lines with visible text; a notice over several lines belongs
    to the one it begins in.  Whole texts are scanned and every segment is
    classified.  Null and empty texts have no paragraphs; rows that repeat are
    scanned each; an empty table gives no rows; other columns are ignored.
    """
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for block in blocks(batches, "text", 1 << 20):
            data, offsets = byte_buffers(block.column(1))
            own = Block(data, offsets)
            n = len(offsets) - 1
            lines = np.bincount(own.text_of_line[own.visible], minlength=n)
            number = np.cumsum(own.visible) - own.visible  # visible lines of the block before
            before = np.cumsum(lines) - lines
            characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
            found: list[list[dict]] = [[] for _ in range(n)]
            for line, family, p in scanner.notices(own, confidence, coverage):
                text = int(own.text_of_line[line])
                start = int(characters[own.lines[line]] - characters[offsets[text]])
                found[text].append({"paragraph": int(number[line] - before[text]), "start": start, "family": family, "probability": p})
            names = [[x["family"] for x in f] for f in found]
            families = [",".join(f"{f}:{own_names.count(f)}" for f in sorted(set(own_names))) for own_names in names]
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("start", pa.int64()), ("family", pa.string()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(lines.astype(np.int64)), pa.array([len(f) for f in found], pa.int64()), pa.array(families, pa.string()), pa.array(found, kind)],
                ["doc_id", "n_paragraphs", "n_licence", "families", "found"],
            )

    schema = "doc_id long, n_paragraphs long, n_licence long, families string, found array<struct<paragraph: int, start: long, family: string, probability: double>>"
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)
