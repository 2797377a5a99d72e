"""Licence scans of wrapped notices, short names and SPDX identifiers."""

import pytest

from voxloom.llm import licences

MODEL = licences.train()
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MIT = """Permission is hereby granted, free of charge,
to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software"""


@pytest.mark.parametrize("text, family", [
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL"), ("SPDX-License-Identifier: CC0-1.0", "CC0"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD"),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA"), ("SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: CC-BY-3.0", "CC-BY"), ("SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("MIT License", "MIT"), ("License: MIT", "MIT"), ("GNU General Public License v3.0", "GPL"), ("GPLv3", "GPL"), ("Apache License, Version 2.0", "Apache-2.0"),
    ("GNU Lesser General Public License v2.1", "LGPL"), ("BSD 3-Clause License", "BSD"), ("Mozilla Public License Version 2.0", "MPL-2.0"),
    ("Creative Commons Attribution 4.0", "CC-BY"), ("CC BY-SA 3.0", "CC-BY-SA"), ("CC BY-NC 4.0", "CC-BY-NC"), ("CC0 1.0 Universal", "CC0"),
    ("SPDX-License-Identifier: ISC", "unknown"), ("SPDX-License-Identifier: CC-BY-ND-4.0", "unknown"), ("GNU Affero General Public License", "unknown"),
])
def test_names(text, family):
    assert MODEL.classify(text)[0] == family


def test_every_name():
    wrong = [(name, family) for family, names in licences.NAMES.items() for name in names if MODEL.classify(name)[0] != family]
    assert not wrong


@pytest.mark.parametrize("text, found", [
    (GPL, [(0, "GPL")]), (MIT, [(0, "MIT")]),
    ("This work is licensed under a Creative Commons\nAttribution 4.0 International License", [(0, "CC-BY")]),
    ("This work is licensed under a Creative Commons Attribution-\nShareAlike 4.0 International License", [(0, "CC-BY-SA")]),
    ("a line before\nRedistribution and use in source and\nbinary forms, with or without\nmodification, are permitted", [(1, "BSD")]),
    (MIT + "\n" + GPL, [(0, "MIT"), (3, "GPL")]),
    ("Released under the MIT License.\nReleased under the MIT License.", [(0, "MIT"), (1, "MIT")]),
    ("words " * 300 + MIT.replace("\n", " ") + " and words" * 200 + " Licensed under CC BY 4.0", [(0, "CC-BY"), (0, "MIT")]),
    ("the license of the driver\nwas granted by permission\nof the public", []),
])
def test_notices(text, found):
    assert [(k, family) for k, family, _ in MODEL.notices(text.split("\n"))] == found


def test_scan_of_wrapped_notices(spark):
    text = "A title\n\n" + GPL + "\n\nmore\n" + MIT
    row = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_paragraphs"] == 9 and row["families"] == "GPL:1,MIT:1"
    assert [(f["paragraph"], text[f["start"] :].split(" ")[0]) for f in row["found"]] == [(1, "This"), (6, "Permission")]
