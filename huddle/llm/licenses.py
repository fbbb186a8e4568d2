"""License scans: sparse TF-IDF cosine to licence templates, then inheritance
from the nearest ancestor directory.  Built-in functions only.

``scan`` compares a text that speaks of a licence (``HINT``) with two sets of
templates, each with the idf of its own terms (a term of none has the largest
idf, so foreign words cost similarity):

* the whole text with whole licence texts (``license_texts/``; tf as 1 + ln n,
  so that common words do not decide), a match from ``LEAST_TEXT`` on;
* every sentence and every paragraph with notices, SPDX lines, heads of
  licence texts, short names and choices (``TEMPLATES``, ``MORE_TEMPLATES``), a match from ``LEAST`` on.

Before notices go SPDX expressions: all their identifiers and operators stay
(``MIT OR Apache-2.0``, ``LGPL-3.0-or-later``); several different ones of a
text are joined by AND.  A notice that offers a choice gives all licences it
names, joined by OR; "or any later version" is kept; a unit that denies a
licence ("is not released under") names none.

A template stands for a family (GNU, Creative Commons, BSD ...).  Members of a
family share most terms, so the distinguishing terms of the matched unit name
the licence: the version, Affero or Lesser, NC, SA, ND, the number of clauses.
A family whose own terms are not in the unit is no match; a notice without a
version gives the family's name without one ("GPL", "CC-BY").  A match of the
whole text decides; else SPDX expressions (score 1), else a choice, else the best
notice (ties by name), one without a version only
where none has one, "All rights reserved" only where nothing else is named.  The templates are constants of the plan, so
this is one pass over the texts without a shuffle.  A document is a licence
file when its whole text is a licence text, or when its best notice holds at
least half of its terms.

``inherit`` gives a file without a licence the one of its nearest ancestor
directory that holds a licence file.  Distinct parent directories, not files,
are joined with their ancestors, so a directory with very many files is one
row there; files then look their parent up.

Defined results: null or empty text has no licence and score 0; a null path
inherits nothing and gives nothing; a directory with several licence files has
the licence of the best score (ties by name); repeated rows give repeated
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import let, small, written

_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
       ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_GNU_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
               "Free Software Foundation, either version {} of the License")
# Names and wording of common licence notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU_HEADER.format("General Public License", 3)),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", _GNU_HEADER.format("General Public License", 2)),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "Licensed under the GPL v2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", _GNU_HEADER.format("Lesser General Public License", 2.1)),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU_HEADER.format("Affero General Public License", 3)),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0, Creative Commons Zero."),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k, _ in _CC),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in _CC),
    *((k.removesuffix("-only"), f"SPDX-License-Identifier: {k}") for k in (
        "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "AGPL-3.0-only", "BSD-2-Clause", "BSD-3-Clause",
        "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0")),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)
#: Short names and choices; compared like the others, but the idf is that of
#: the notices of one licence above.
MORE_TEMPLATES = (
    *((f"CC-{k}-4.0", f"Creative Commons {k} 4.0") for k, _ in _CC),
    ("Apache-2.0 OR MIT", "You may choose either the MIT license or the Apache License, Version 2.0."),
    ("Apache-2.0 OR MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("Apache-2.0 OR MIT", "Dual-licensed under the MIT License and the Apache License, Version 2.0."),
    ("GPL OR MIT", "Dual licensed under the MIT or GPL licenses."),
    ("BSD-3-Clause OR MIT", "Available under either the MIT or the BSD license."),
    ("GPL-2.0 OR MIT", "This file is dual-licensed: you can choose either the GNU General Public License version 2 or the MIT license."),
    ("GPL-2.0-or-later OR MIT", "Dual licensed under the GNU General Public License version 2 or any later version, or the MIT license."),
)
#: Licence texts by file name in ``license_texts``.
TEXTS = ("Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
         "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0")
LEAST, LEAST_TEXT = 0.6, 0.75
#: Every template has a match; units of text without one are not compared.
HINT = r"(?i)licen[sc]e|permission|redistribut|rights reserved|creative commons|\bcc[\x20-]by\b|\bcc0\b|gpl"
PARAGRAPH, SENTENCE, NO_TERM = r"\n[\x20\t\r]*\n", r"\n|(?<=[.;!?])[\x20\t\r]+", "[^a-z0-9]+"
#: Directories with a licence that are broadcast at most; beyond, joins shuffle.
MAX_DIRECTORIES = 200_000
#: Families that a notice names without the version.
NO_VERSION = "^([AL]?GPL|Apache|MPL|CC-BY[A-Z-]*)$"
#: Words of a choice, of a denied licence and of later versions.
CHOICE = r"\b(either|dual|dually|triple|tri|choose|choice|option|alternatively)\b"
DENIED = (r"\b(not|never|neither|nor|no longer|isn t|aren t|wasn t)( [a-z0-9]+){0,3} "
          r"(licen[sc]ed|released|distributed|available|provided|published|covered|offered|under)\b")
LATER = r"\bor (?:at your option )?(?:any )?later(?: versions?)?\b"
#: A header that goes on with this in its next line.
HEADER_LATER = r"\bversion [123]( [0-9])? of the licen[sc]e or at your option any later version\b"
_SPDX_PART = r"\(*[a-z0-9.-]+\+?\)*"
SPDX = rf"(?i)SPDX-License-Identifier:[\x20\t]*({_SPDX_PART}(?:[\x20\t]+(?:AND|OR|WITH)[\x20\t]+{_SPDX_PART})*)"
_BUCKETS = 4096


def _weights(texts: list[str], damped: bool, counted: int) -> tuple[dict[str, float], list[dict[str, float]]]:
    """idf by term, of the first ``counted`` templates, and the unit TF-IDF
    vector of each template."""
    tf = [Counter(re.findall("[a-z0-9]+", text.lower())) for text in texts]
    df = Counter(w for c in tf[:counted] for w in c)
    idf = {w: 1 + math.log(counted / max(df[w], 1)) for w in sorted(set().union(*tf))}
    vectors = []
    for counts in tf:
        v = {w: (1 + math.log(n) if damped else n) * idf[w] for w, n in sorted(counts.items())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    return idf, vectors


@lru_cache(maxsize=2)
def _table(whole: bool) -> tuple[str, int, float]:
    """idf and the value in each template by term, in buckets by the term's
    hash (a look-up in one map goes through its keys), the number of templates
    and the idf of other terms."""
    from xxhash import xxh64_intdigest
    folder = resources.files("huddle.llm") / "license_texts"
    texts = [(folder / f"{k}.txt").read_text("utf-8") for k in TEXTS] if whole else [text for _, text in TEMPLATES + MORE_TEMPLATES]
    counted = len(TEXTS if whole else TEMPLATES)
    idf, vectors = _weights(texts, whole, counted)
    buckets: list[dict] = [{} for _ in range(_BUCKETS)]
    for w, x in idf.items():
        buckets[xxh64_intdigest(w.encode(), 42) % _BUCKETS][w] = {"i": x, "v": [v.get(w, 0.0) for v in vectors]}
    return json.dumps(buckets), len(texts), 1 + math.log(counted)


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NO_TERM), lambda w: w != "")


def _counted(terms: Column) -> Column:
    """(term, n) of sorted terms, of which there are some."""
    n = F.size(terms)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(terms, i - 1) != F.get(terms, i)))
    return let(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(n)), lambda a, b: F.struct(
        F.get(terms, a).alias("term"), (b - a).cast("double").alias("n"))))


def _cosines(terms: Column, whole: bool) -> Column:
    """The cosine of ``terms`` (sorted, not empty) to every template."""
    table, n_templates, other = _table(whole)
    buckets = F.from_json(F.lit(table), "array<map<string,struct<i:double,v:array<double>>>>")
    other = F.lit(other)

    def weighted(e: Column) -> Column:
        hit = F.try_element_at(F.get(buckets, F.pmod(F.xxhash64(e["term"]), F.lit(_BUCKETS)).cast("int")), e["term"])
        tf = 1 + F.log(e["n"]) if whole else e["n"]
        return let(hit, lambda h: F.struct((tf * F.coalesce(h["i"], other)).alias("w"), h["v"].alias("v")))

    def product(rows: Column) -> Column:
        norm = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["w"] * r["w"], F.sqrt)
        dots = F.aggregate(F.filter(rows, lambda r: r["v"].isNotNull()), F.array(*[F.lit(0.0)] * n_templates),
                           lambda a, r: F.zip_with(a, r["v"], lambda x, y: x + r["w"] * y))
        return let(norm, lambda z: F.transform(dots, lambda d: d / z))
    return let(F.transform(_counted(terms), weighted), product)


def _version(words: Column, before: str, numbers: str) -> Column:
    """'-2.1' of the first version number after ``before``, '' without one."""
    pattern = rf"(?:{before}) ?v?({numbers})(?: ([0-9]))?\b"
    major, minor = (F.regexp_extract(words, pattern, k) for k in (1, 2))
    return F.when(major == "", F.lit("")).otherwise(F.concat(F.lit("-"), major, F.lit("."), F.when(minor == "", F.lit("0")).otherwise(minor)))


def _members(words: Column, text: Column) -> dict[str, Column]:
    """The member of each family that the distinguishing terms of a unit's
    words (joined by one blank) name, null where they name none; ``text``: the
    words of the whole document."""
    def has(pattern: str, where: Column = words) -> Column:
        return where.rlike(pattern)

    def part(pattern: str, name: str) -> Column:
        return F.when(has(pattern), F.lit(name)).otherwise(F.lit(""))
    gnu = F.when(has(r"\baffero\b|\bagpl"), F.lit("AGPL")).when(has(r"\b(lesser|library) general public|\blgpl"), F.lit("LGPL")).when(
        has(r"\bgeneral public licen|\bgpl|\bgnu licen"), F.lit("GPL"))
    creative = F.concat(F.lit("CC-BY"), part(r"\bnc\b|\bnon ?commercial\b", "-NC"), part(r"\bsa\b|\bshare ?alike\b", "-SA"),
                        part(r"\bnd\b|\bno ?deriv", "-ND"),
                        _version(words, r"(?:\bcc by|\battribution|\bcommons by|\blicenses by)(?: (?!v?[0-9])[a-z]+){0,6}", "[1-4]"))
    no_endorsement = has("redistributions in binary form must reproduce", text) & ~has("endorse or promote", text)
    bsd = F.when(has(r"\b(2|two) clause\b|\bsimplified bsd\b"), F.lit("BSD-2-Clause")).when(
        has(r"\b(3|three) clause\b|\bnew bsd\b"), F.lit("BSD-3-Clause")).when(has(r"\b(4|four) clause\b"), F.lit("BSD-4-Clause")).when(
        has("all advertising materials mentioning", text), F.lit("BSD-4-Clause")).when(no_endorsement, F.lit("BSD-2-Clause")).otherwise(F.lit("BSD-3-Clause"))
    isc = r"\bpermission to use copy modify and (or )?distribute"
    return {
        "MIT": F.when(has(r"\bmit\b|\bpermission is hereby granted free of charge"), F.lit("MIT")),
        "Apache": F.when(has(r"\bapache\b"), F.concat(F.lit("Apache"), _version(words, r"\bversion|\bv|\blicen[sc]e|\bapache", "[12]"))),
        "GNU": let(_version(words, r"\bversion|\bv|\blicen[sc]e|gpl", "[123]"), lambda v: F.concat(
            gnu, v, F.when((v != "") & (has(r"\borlater\b") | has(HEADER_LATER, text)), F.lit("-or-later")).otherwise(F.lit("")))),
        "BSD": F.when(has(r"\bbsd\b|\bredistribution and use in source and binary"), bsd),
        "ISC": F.when(has(r"\bisc\b"), F.lit("ISC")).when(
            has(isc) & has("provided that the above copyright notice", text), F.lit("ISC")).when(has(isc), F.lit("0BSD")),
        "MPL": F.when(has(r"\bmozilla public|\bmpl\b"), F.concat(F.lit("MPL"), _version(words, r"\bversion|\bv|\blicen[sc]e|\bmpl", "[12]"))),
        "CC": F.when(has(r"\bcc ?0\b|\bcreative commons zero\b"), F.lit("CC0-1.0")).when(
            has(r"\bcc by\b|\bcommons (attribution|by)\b|^attribution|\blicenses by\b"), creative),
        "LicenseRef": F.when(has(r"\brights reserved\b"), F.lit("LicenseRef-All-Rights-Reserved")),
    }


def _choice(words: Column) -> Column:
    """All licences that the parts of a choice name, joined by OR; null of
    fewer than two."""
    def name(part: Column) -> Column:
        return F.coalesce(*[m for family, m in _members(part, part).items() if family != "LicenseRef"])
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(words, r"\b(?:or|and)\b"), name), lambda n: n.isNotNull())))
    return let(names, lambda n: F.when(F.size(n) > 1, F.array_join(n, " OR ")))


def _spdx(text: Column) -> Column:
    """(license, number of terms) of the SPDX expressions of a text."""
    def plain(e: Column) -> Column:
        for word in ("AND", "OR", "WITH"):
            e = F.regexp_replace(e, rf"(?i)[\x20\t]+{word}[\x20\t]+", f" {word} ")
        e = F.regexp_replace(F.regexp_replace(e, r"[.-]+(?=[\x20)]|$)", ""), r"(?i)-only\b", "")
        e = F.regexp_replace(F.regexp_replace(e, r"\+", "-or-later"), r"^\(([^()]*)\)$", "$1")
        return F.when(F.instr(e, "(") == 0, F.replace(e, F.lit(")"), F.lit(""))).otherwise(e)

    def joined(names: Column) -> Column:
        several = F.transform(names, lambda e: F.when(e.contains(" OR "), F.concat(F.lit("("), e, F.lit(")"))).otherwise(e))
        return F.when(F.size(names) == 1, F.get(names, 0)).otherwise(F.array_join(several, " AND "))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), plain), lambda e: e != "")))
    n_terms = F.size(terms_of(F.array_join(F.regexp_extract_all(text, F.lit(SPDX), F.lit(0)), " ")))
    return let(names, lambda n: F.when(F.size(n) > 0, F.struct(joined(n).alias("license"), n_terms.alias("n_terms"))))


def _family(name: str) -> str:
    if " OR " in name:
        return "choice"
    head = re.split("[-0-9]", name)[0]
    return "GNU" if head in ("GPL", "LGPL", "AGPL") else head


def _best(terms: Column, text: Column) -> Column:
    """(rank, -cosine, licence, number of terms) of the notice nearest to
    ``terms`` of those that name a licence, of all when none does.  Rank -1 is
    a choice, 0 a name, 1 a family without its version, 2 "All rights reserved", 3 none."""
    def nearest(cosines: Column) -> Column:
        def none() -> Column:
            return F.struct(F.lit(3).alias("rank"), (-F.array_max(cosines)).alias("s"), F.lit(None).cast("string").alias("license"), F.size(terms).alias("n_terms"))

        def named(words: Column) -> Column:
            members = _members(words, text) | {"choice": F.when(words.rlike(CHOICE), _choice(words))}
            found = F.array(*[
                F.struct(F.when(member.isNull() | (s < LEAST), F.lit(3)).when(member.rlike(NO_VERSION), F.lit(1)).otherwise(
                    F.lit({"LicenseRef": 2, "choice": -1}.get(family, 0))).alias("rank"),
                         (-s).alias("s"), member.alias("license"), F.size(terms).alias("n_terms"))
                for family, member in members.items()
                for s in [F.array_max(F.array(*[F.get(cosines, F.lit(k)) for k, (n, _) in enumerate(TEMPLATES + MORE_TEMPLATES) if _family(n) == family]))]])
            return F.when(words.rlike(DENIED), none()).otherwise(F.array_min(found))
        words = F.regexp_replace(F.array_join(terms, " "), LATER, "orlater")
        return F.when(F.array_max(cosines) < LEAST, none()).otherwise(let(words, named))
    return let(F.array_sort(terms), lambda t: let(_cosines(t, False), nearest))


def _whole(words: Column) -> Column:
    """(-cosine, licence) of the licence text nearest to a document's words;
    null below ``LEAST_TEXT``."""
    def nearest(cosines: Column) -> Column:
        best = F.array_min(F.zip_with(cosines, F.array(*[F.lit(k) for k in TEXTS]), lambda c, k: F.struct((-c).alias("s"), k.alias("license"))))
        return F.when(F.array_max(cosines) >= LEAST_TEXT, let(best, own))

    def own(b: Column) -> Column:
        # texts of one family differ in a few words: the title or a clause
        text = F.array_join(words, " ")
        head = F.array_join(F.slice(words, 1, 40), " ")
        title = F.regexp_extract(text, r"\battribution( noncommercial)?( sharealike| noderivatives)? [1-4] [05]\b", 0)
        members = _members(F.when(title != "", title).otherwise(head), text)
        name = F.when(b["license"].startswith("CC-BY"), members["CC"]).when(b["license"].startswith("BSD"), let(text, lambda t: _members(t, t)["BSD"])).when(
            b["license"] == "ISC", let(text, lambda t: _members(t, t)["ISC"])).when(
            (b["license"] == "GPL-3.0") & text.rlike(r"\baffero general public license version 3 19 november 2007\b"), F.lit("AGPL-3.0"))
        return F.struct(b["s"].alias("s"), F.coalesce(name, b["license"]).alias("license"))
    return let(F.array_sort(words), lambda t: let(_cosines(t, True), nearest))


def scan(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """doc_id, path, license (null: none), score (of the template that names
    it, else of the nearest notice) and is_file of each row of ``docs``."""
    path = F.lit(None).cast("string") if path is None else path
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    units = F.filter(F.array_distinct(F.concat(F.split(text, PARAGRAPH), F.split(text, SENTENCE))), lambda u: u.rlike(HINT))
    words = F.regexp_replace(F.lower(text), NO_TERM, " ")
    near = F.array_min(F.transform(units, lambda u: let(terms_of(u), lambda t: _best(t, words))))
    rows = rows.withColumns({"near": F.when(text.rlike(HINT), near), "whole": F.when(text.rlike(HINT), let(terms_of(text), _whole)),
                              "spdx": F.when(text.rlike(SPDX), _spdx(text))})
    named = F.col("near.rank") < 3
    return rows.select(
        "doc_id", "path", F.coalesce("whole.license", "spdx.license", F.when(named, F.col("near.license"))).alias("license"),
        F.coalesce(-F.col("whole.s"), F.when(F.col("spdx.license").isNotNull(), F.lit(1.0)), -F.col("near.s"), F.lit(0.0)).alias("score"),
        F.when(F.col("whole.license").isNotNull(), F.lit(True)).when(
            F.col("spdx.license").isNotNull(), 2 * F.col("spdx.n_terms") >= F.size(terms_of(text))).when(named, 2 * F.col("near.n_terms") >= F.size(terms_of(text))).otherwise(F.lit(False)).alias("is_file"))


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def directory_licenses(files: DataFrame) -> DataFrame:
    """(path, license) of the directories that hold a licence file; ``files``
    as ``scan`` returns them."""
    own = files.where("is_file and path is not null").groupBy(parent(F.col("path")).alias("directory"))
    best = own.agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select(F.col("directory").alias("path"), F.col("b.license").alias("license"))


def inherit(files: DataFrame, directories: DataFrame) -> DataFrame:
    """``files`` (path, license, more) with inherited_license and
    inherited_from (null where the file has a licence of its own or no
    ancestor has one); ``directories``: (path, license), a path once."""
    files = files.withColumn("parent_directory", F.when(F.col("license").isNull(), parent(F.col("path"))))
    parts = F.filter(F.split("parent_directory", "/"), lambda p: p != "")
    ups = files.where("parent_directory is not null").select("parent_directory").distinct().select(
        "parent_directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(
            F.when(F.col("parent_directory").startswith("/") & (k > 0), F.lit("/")).otherwise(F.lit("")),
            F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("up"))
    licensed = small(written(directories.select(F.col("path").alias("up"), F.col("license").alias("from_up")), "license-directories"), MAX_DIRECTORIES)
    near = ups.join(licensed, "up").groupBy("parent_directory").agg(F.max(F.struct(F.length("up").alias("n"), "up", "from_up")).alias("m"))
    near = near.select("parent_directory", F.col("m.from_up").alias("inherited_license"), F.col("m.up").alias("inherited_from"))
    near = small(written(near, "license-parents"), MAX_DIRECTORIES)
    return files.join(near, "parent_directory", "left").drop("parent_directory")


def report(docs: DataFrame, path: Column) -> DataFrame:
    """``scan`` with inherited licences: doc_id, license, score, is_file,
    inherited_license, inherited_from."""
    files = written(scan(docs, path), "license-files")
    return inherit(files, directory_licenses(files)).drop("path")
