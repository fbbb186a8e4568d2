"""License scans against brute-force cosines, and inheritance over paths."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from huddle.llm import licenses

ROWS = [
    (1, "src0", "Some prose of any kind.\nReleased under the MIT License.\nMore prose after it."),
    (2, "src0", "Licensed under the Apache License, Version 2.0."),
    (3, "src1", "Licensed under CC BY-NC 4.0."),
    (4, "src1", "word " * 30000 + "end. This work is licensed under the GNU General Public License, version 3. " + "word " * 10),
    (5, "src1", "/*\n * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated\n"
                " * documentation files, to deal in the Software without restriction\n */\n\nint main() {}"),
    (6, "src0", "You need a driving license and the permission of your parents to go there."),
    (7, "src0", "Copyright 2020 Someone. All rights reserved.\n\nAll rights reserved."),
    (8, "src2", None), (9, None, ""), (None, "src0", "no notice"), (6, "src2", "no notice"), (6, "src2", "no notice"),
    (10, "src0", "license " * 5000),
    # a notice in the middle of a sentence of many other words is none
    (11, "src3", "word " * 300 + "This work is licensed under the GNU General Public License, version 3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string").repartition(3)
    return df.selectExpr("*", "'x' AS license", "'y' AS path", "'z' AS near", "0D AS score", "'w' AS parent_directory")


def cosine(a, b):
    return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def brute(text):
    templates = licenses.TEMPLATES + licenses.MORE_TEMPLATES
    count = [Counter(re.findall("[a-z0-9]+", t.lower())) for _, t in templates]
    ours = count[:len(licenses.TEMPLATES)]
    idf = {w: 1 + math.log(len(ours) / sum(w in c for c in ours)) for c in ours for w in c}

    def vector(c):
        return {w: n * idf.get(w, 1 + math.log(len(ours))) for w, n in c.items()}
    units = re.split(r"\n[ \t\r]*\n", text) + re.split(r"\n|(?<=[.;!?])[ \t\r]+", text)
    found = []
    for u in units:
        if re.search(licenses.HINT, u):
            terms = re.findall("[a-z0-9]+", u.lower())
            found += [(-cosine(vector(Counter(terms)), vector(c)), name, len(terms)) for (name, _), c in zip(templates, count)]
    s, name, n = min(found, default=(0.0, None, 0))
    named = -s >= licenses.LEAST
    return name if named else None, -s, named and 2 * n >= len(re.findall("[a-z0-9]+", text.lower()))


def test_scan(docs):
    found = {(r.doc_id, r.path): r for r in licenses.scan(docs, F.col("source")).collect()}
    assert len(found) == len({(i, p) for i, p, _ in ROWS})
    for i, p, text in ROWS:
        name, score, is_file = brute(text or "")
        r = found[i, p]
        assert (r.license, r.is_file) == (name, is_file) and abs(r.score - score) < 1e-9
    assert [found[k].license for k in ((1, "src0"), (2, "src0"), (3, "src1"), (4, "src1"), (5, "src1"), (6, "src0"), (11, "src3"))] == [
        "MIT", "Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT", None, None]


@pytest.mark.parametrize("text, name", [
    ("This software is not released under the MIT License.", None),
    ("It is no longer distributed under the GNU General Public License, version 3.", None),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
    ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note)\nint x;", "GPL-2.0 WITH Linux-syscall-note"),
    ("/* SPDX-License-Identifier: LGPL-3.0-or-later */ int x;", "LGPL-3.0-or-later"),
    ("SPDX-License-Identifier: GPL-2.0+.", "GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: MIT\n# spdx-license-identifier:\tISC or 0BSD\n", "(ISC OR 0BSD) AND MIT"),
    ("SPDX-License-Identifier:", None),
    ("You may choose either the MIT license or the Apache License, Version 2.0", "Apache-2.0 OR MIT"),
    ("Dual licensed under the GNU General Public License version 2 or any later version, or the MIT license.", "GPL-2.0-or-later OR MIT"),
    ("Licensed under the Apache License, Version 2.0 or any later version.", "Apache-2.0"),
    ("Creative Commons BY-SA 3.0", "CC-BY-SA-3.0"),
    (licenses._GNU_HEADER.format("General Public License", 3) + ", or (at your option) any later version.", "GPL-3.0-or-later"),
])
def test_expressions_choices_and_denials(spark, text, name):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.license for r in licenses.scan(df).collect()] == [name]


def test_every_template_is_named_and_has_a_hint(spark):
    rows = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(licenses.TEMPLATES + licenses.MORE_TEMPLATES)], "doc_id long, text string")
    got = {r.doc_id: (r.license, round(r.score, 9), r.is_file) for r in licenses.scan(rows).collect()}
    assert got == {k: (n, 1.0, True) for k, (n, _) in enumerate(licenses.TEMPLATES + licenses.MORE_TEMPLATES)}


def test_report_inherits_from_the_source(docs):
    found = licenses.report(docs, F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    assert found.columns == ["doc_id", "license", "score", "is_file", "inherited_license", "inherited_from"]
    rows = found.collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: (r.inherited_license, r.inherited_from) for r in rows if r.doc_id != 6}
    # src0 has two licence files of score 1: the first name
    assert by_id[10] == ("Apache-2.0", "src0") and by_id[1] == (None, None) and by_id[8] == (None, None) and by_id[9] == (None, None)
    # a null doc_id gives a null path
    assert by_id[None] == (None, None)
    assert sorted(r.inherited_license or "" for r in rows if r.doc_id == 6) == ["", "", "Apache-2.0"]


def test_inherit_takes_the_nearest_ancestor(spark):
    files = spark.createDataFrame(
        [("a/b/c/x.py", None), ("a/b/y.py", None), ("a/z.py", None), ("q.py", None), ("a/b/own.py", "BSD"), ("ab/x.py", None),
         ("/abs/d/x", None), (None, None), ("", None)], "path string, license string")
    own = spark.createDataFrame([("a", "MIT"), ("a/b", "GPL"), ("/abs", "ISC"), ("ab/x", "no")], "path string, license string")
    got = {r.path: (r.inherited_license, r.inherited_from) for r in licenses.inherit(files, own).collect()}
    none = (None, None)
    assert got == {"a/b/c/x.py": ("GPL", "a/b"), "a/b/y.py": ("GPL", "a/b"), "a/z.py": ("MIT", "a"), "q.py": none, "a/b/own.py": none,
                   "ab/x.py": none, "/abs/d/x": ("ISC", "/abs"), None: none, "": none}
    root = spark.createDataFrame([("", "MIT")], "path string, license string")
    assert {r.inherited_license for r in licenses.inherit(files.where("path = 'q.py' or path = '/abs/d/x'"), root).collect()} == {"MIT"}


def test_empty(docs):
    assert licenses.report(docs.where("false"), F.col("source")).count() == 0
