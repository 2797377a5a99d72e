"""Notices written after the training was settled, scored once and then kept as
they are.  Nothing was tuned on them; whoever changes the training while looking
at them has to write others for an independent figure."""

from voxloom.llm.licences import scan_licences

NOTICES = [
    ("Apache-2.0", "Copyright 2019 Jane Doe. This software is made available under Apache 2.0, see LICENSE for details."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "The source code in this folder is covered by the Apache License 2.0."),
    ("MIT", "MIT licensed. See the LICENSE file in the project root."),
    ("MIT", "The code samples on this page are available under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL", "This package is free software under GPLv3."),
    ("GPL", "Our plugin is distributed under the GNU General Public License, either version 2 or, at your option, any later version."),
    ("GPL", "See the GNU General Public License for more details."),
    ("LGPL", "The library may be linked with closed programs as it is under the LGPL 2.1."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License version 3 only."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD", "Published under the 3-clause BSD license."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "These extensions are under the Mozilla Public License version 2.0."),
    ("CC-BY", "All figures on this site may be reused under CC BY 4.0 with credit."),
    ("CC-BY", "Text is available under the Creative Commons Attribution 4.0 International licence."),
    ("CC-BY-SA", "Content of this wiki is available under CC BY-SA 3.0 unless noted otherwise."),
    ("CC-BY-SA", "You may share it under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("CC-BY-NC", "Photos are shared under a Creative Commons Attribution-NonCommercial 4.0 license."),
    ("CC-BY-NC", "For teaching only: CC BY-NC 4.0."),
    ("CC0", "The author waives all rights: CC0 1.0 Universal public domain dedication."),
    ("CC0", "Data are released into the public domain with CC0."),
]
OTHERS = [
    "The Eclipse Public License 2.0 applies to this component.",
    "Licensed under the ISC license.",
    "This work is under the GNU Affero General Public License v3.",
    "Boost Software License, Version 1.0",
    "Licensed under the European Union Public Licence 1.2.",
    "All rights reserved. No part of this text may be reproduced without written permission.",
    "She renewed her driving licence at the counter in the town hall last week.",
    "The museum is open to the public and admission is free for children.",
    "The Apache people lived in the southwest for centuries.",
    "He studied physics at MIT before he moved to Boston.",
    "The software update fixes a fault in the map display.",
    "This code is no longer available under the MIT license.",
    "We do not accept patches that are licensed under the GPL.",
    "A creative approach to common problems in attribution models.",
    "The general public may attend the meeting on Monday.",
    "Mozilla published a new version of its browser.",
    "Commercial use of the hall needs a permit from the council.",
    "The council voted on the version of the plan that was released in May.",
    "BSD systems are known for their networking code.",
    "Public domain stories are often retold.",
]


def test_unseen_notices(spark):
    """16 of 24 are named, the others unknown: none is taken for another family."""
    texts = [t for _, t in NOTICES] + OTHERS
    rows = scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: r.families.split(":")[0] for r in rows}
    named = [found[k] for k in range(len(NOTICES))]
    assert all(x in ("", f) for x, (f, _) in zip(named, NOTICES, strict=True))
    assert sum(x != "" for x in named) >= 16
    assert not any(found[len(NOTICES) + k] for k in range(len(OTHERS)))
