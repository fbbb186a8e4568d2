"""License scans on whole licence texts, SPDX lines and near-miss notices."""

from importlib import resources

import pytest

from huddle.llm import licenses

GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; "
NOTICES = [
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
    ("Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-Non-Commercial 3.0 Unported License.", "CC-BY-NC-3.0"),
    (GNU.format("General Public License") + "either version 2 of the License, or (at your option) any later version.", "GPL-2.0-or-later"),
    (GNU.format("General Public License").replace(";", ",") + "either version 2\nof the License, or (at your option) any later version.", "GPL-2.0-or-later"),
    (GNU.format("General Public License").replace(";", ",") + "either version 3 of the License.", "GPL-3.0"),
    (GNU.format("Affero General Public License").replace(";", ",") + "either version 3 of the License.", "AGPL-3.0"),
    ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("This work is licensed under the GNU General Public License.", "GPL"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("/* SPDX-License-Identifier: BSD-2-Clause */", "BSD-2-Clause"), ("SPDX-License-Identifier: ISC", "ISC"), ("SPDX-License-Identifier: Zlib", "Zlib"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"), ("Licensed under the Example License, Version 2.0.", None),
    ("This library is released under the MIT License.", "MIT"), ("Released under the ISC License.", "ISC"),
    ("\tApache License\n\tVersion 2.0, January 2004\n\thttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS", "Apache-2.0"),
]


def text_of(name):
    return (resources.files("huddle.llm") / "license_texts" / f"{name}.txt").read_text("utf-8")


@pytest.fixture(scope="module")
def found(spark):
    def run(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        return [(r.license, r.is_file) for r in sorted(licenses.scan(rows).collect(), key=lambda r: r.doc_id)]
    return run


def test_near_miss_notices(found):
    got = found([f"Some prose.\n\n{text}\n\nMore of it." for text, _ in NOTICES])
    assert [(t, w, n) for (t, w), (n, _) in zip(NOTICES, got) if w != n] == []


def test_whole_texts_are_licence_files(found):
    own = {k: "Copyright (c) 2021 Some One, Some Company\n\n" + text_of(k) for k in licenses.TEXTS}
    gpl = text_of("GPL-3.0").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1).replace("29 June 2007", "19 November 2007", 1)
    own["AGPL-3.0"] = gpl
    share = text_of("CC-BY-SA-4.0")
    own["CC-BY-4.0"] = share.replace("Attribution-ShareAlike", "Attribution")
    own["CC-BY-NC-4.0"] = share.replace("Attribution-ShareAlike", "Attribution-NonCommercial")
    assert dict(zip(own, found(list(own.values())))) == {k: (k, True) for k in own}


def test_texts_in_longer_files(found):
    code = "\n\n" + "\n".join(f"def call_{k}(first, second): return first * {k} + second" for k in range(300))
    comments = ["/*\n" + "\n".join(f" * {x}" for x in text_of(k).split("\n")) + "\n */" for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")]
    assert found([c + code for c in comments]) == [("MIT", False), ("BSD-2-Clause", False), ("BSD-3-Clause", False), ("ISC", False)]
