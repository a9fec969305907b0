"""License scans, in DataFrame functions only.

Files are compared with templates by the cosine of sparse TF-IDF vectors; idf is
counted over all files for the templates' terms (a term of no template has the
largest weight). What is compared: each line, and a licence file as a whole;
where none of these suffices, every run of two to WINDOW adjacent lines that have
terms. Lines and runs are held to the notices, in licence files also to titles,
a whole licence file to full texts too. A file without a licence of its own
inherits that of the licence file in the nearest directory above it, by joins on
path prefixes.

Two bounds end most work early and lose nothing, by Cauchy-Schwarz: a unit must
hold one of a template's anchor terms (the others together are too short), and
its terms must make up the threshold's square of some template's length. A run of
more than twice the terms of the longest notice isn't scored. Scores are computed
within the row, so a row's licence is its own, whatever its key.

Defined cases: null or empty texts have no licence of their own; a null path is a
file outside every directory; of equal cosines the first line, then the first
licence name counts, then the shorter run; null keys and rows that repeat are
judged row by row; other columns pass through, the result's own names excepted.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.store import written

#: Common notices of public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Further notices.
BLOCKS = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[(x, f"SPDX-License-Identifier: {x}") for x in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense")],
]
#: Titles of licence texts, for licence files only.
TITLES = [
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "ISC License"),
    ("Unlicense", "The Unlicense"),
]
#: Whole texts, for licence files as a whole.
FULL = [
    ("MIT", 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-3-Clause", 'BSD 3-Clause License Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
]
#: Which templates a unit is held to: kinds up to NOTICE, up to TITLE in licence files, up to TEXT for them as a whole.
NOTICE, TITLE, TEXT = 0, 1, 2
ALL = [(NOTICE, *x) for x in TEMPLATES + BLOCKS] + [(TITLE, *x) for x in TITLES] + [(TEXT, *x) for x in FULL]
WINDOW = 8
THRESHOLD = 0.8
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
OUT = ("license", "score", "line_no", "basis")


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def template_terms() -> list[tuple[int, str, Counter]]:
    """(kind, licence, term counts) of all templates."""
    return [(kind, name, Counter(re.findall("[a-z0-9]+", text.lower()))) for kind, name, text in ALL]


def longest_run() -> int:
    return 2 * max(sum(c.values()) for kind, _, c in template_terms() if kind < TEXT)


def document_frequencies(files: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """(files, files with each term of the templates), in one scan; the driver gets as many rows as templates have terms."""
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for _, _, c in template_terms() for t in c})])
    # the empty term stands for the file itself
    found = files.select(F.explode(F.concat(F.array_intersect(_terms(F.col(text)), vocabulary), F.array(F.lit("")))).alias("term"))
    counts = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}
    return counts.pop("", 0), counts


class Weights:
    """idf of the templates' terms and of others, the templates' unit vectors, and their anchor terms."""

    def __init__(self, n: int, df: dict[str, int]):
        found = template_terms()
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for _, _, c in found for t in c}
        self.other = math.log(n + 1) + 1
        self.vectors: list[tuple[int, str, dict[str, float]]] = []
        self.anchors: set[str] = set()
        for kind, name, terms in found:
            vector = {t: tf * self.idf[t] for t, tf in terms.items()}
            norm = math.sqrt(sum(x * x for x in vector.values()))
            self.vectors.append((kind, name, {t: x / norm for t, x in vector.items()}))
            rest = 1.0
            for t in sorted(vector, key=lambda t: (-vector[t], t)):
                if rest < THRESHOLD**2 - 1e-9:
                    break
                self.anchors.add(t)
                rest -= (vector[t] / norm) ** 2

    def templates(self) -> Column:
        """One constant, parsed while the plan is made."""
        rows = [{"kind": kind, "license": name, "terms": [{"t": t, "m": x} for t, x in sorted(v.items())]} for kind, name, v in self.vectors]
        return F.from_json(F.lit(json.dumps(rows)), "array<struct<kind:int,license:string,terms:array<struct<t:string,m:double>>>>")

    def idfs(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.idf, sort_keys=True)), "map<string,double>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def own_license(path: Column, text: Column, weights: Weights) -> Column:
    """struct<s, line_no, license, span> of the best unit, s being the negative score; null without one. line_no -1: a licence file as a whole."""
    templates, idfs = weights.templates(), weights.idfs()
    strings = lambda ts: F.array(*[F.lit(t) for t in sorted(ts)])
    anchors, vocabulary = strings(weights.anchors), strings(weights.idf)
    is_file = F.coalesce(path.rlike(LICENCE_FILE), F.lit(False))

    def weighted(terms: Column) -> Column:
        """term -> tf * idf."""

        def counted(s: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))

            def entries(e: Column) -> Column:
                weight = lambda i, j: (i - F.coalesce(F.get(e, j - 1), F.lit(0))) * F.coalesce(F.try_element_at(idfs, F.get(s, i - 1)), F.lit(weights.other))
                return F.map_from_entries(F.transform(e, lambda i, j: F.struct(F.get(s, i - 1), weight(i, j))))

            return let(ends, entries)

        return let(F.array_sort(terms), counted)

    def scores(unit: Column, most: Column) -> Column:
        """The sufficient (s, line_no, license, span) of a unit (line_no, span, terms)."""

        def hit(held: Column, tm: Column) -> Column:
            share = F.aggregate(tm["terms"], F.lit(0.0), lambda a, p: a + F.when(F.array_contains(held, p["t"]), p["m"] * p["m"]).otherwise(F.lit(0.0)))
            return (tm["kind"] <= most) & (share >= THRESHOLD**2 - 1e-5)

        def of(near: Column) -> Column:
            def cosines(w: Column) -> Column:
                norm = F.sqrt(F.aggregate(F.map_values(w), F.lit(0.0), lambda a, x: a + x * x))
                dot = lambda tm: F.aggregate(tm["terms"], F.lit(0.0), lambda a, p: a + p["m"] * F.coalesce(F.try_element_at(w, p["t"]), F.lit(0.0)))
                rows = F.transform(near, lambda tm: F.struct((-F.round(dot(tm) / norm, 6)).alias("s"), unit["line_no"].alias("line_no"), tm["license"].alias("license"), unit["span"].alias("span")))
                return F.filter(rows, lambda r: r["s"] <= -THRESHOLD)

            return F.when(F.size(near) > 0, let(weighted(unit["terms"]), cosines))

        return let(let(F.array_intersect(unit["terms"], vocabulary), lambda held: F.filter(templates, lambda tm: hit(held, tm))), of)

    def best(units: Column, most: Column) -> Column:
        return F.array_min(F.flatten(F.filter(F.transform(units, lambda u: scores(u, most)), lambda r: r.isNotNull())))

    def runs(lines: Column) -> Column:
        """Runs of two lines or more, each made at its first line with an anchor."""

        def at(near: Column) -> Column:
            def from_near(j: Column, k: Column) -> Column:
                first = F.greatest(F.coalesce(F.get(near, k - 1) + 1, F.lit(0)), j - (WINDOW - 1))

                def from_line(a: Column) -> Column:
                    def run(span: Column) -> Column:
                        part = F.slice(lines, a + 1, span)
                        fits = (a + span <= F.size(lines)) & (F.aggregate(part, F.lit(0), lambda n, x: n + F.size(x["terms"])) <= longest_run())
                        return F.when(fits, F.struct(F.get(lines, a)["line_no"].alias("line_no"), span.alias("span"), F.flatten(F.transform(part, lambda x: x["terms"])).alias("terms")))

                    return F.filter(F.transform(F.sequence(F.greatest(F.lit(2), j - a + 1), F.lit(WINDOW)), run), lambda u: u.isNotNull())

                return F.flatten(F.transform(F.sequence(first, j), from_line))

            return F.flatten(F.transform(near, from_near))

        return let(F.filter(F.transform(lines, lambda x, i: F.when(x["near"], i)), lambda i: i.isNotNull()), at)

    def of_lines(lines: Column) -> Column:
        most = F.when(is_file, F.lit(TITLE)).otherwise(F.lit(NOTICE))
        alone = F.transform(F.filter(lines, lambda x: x["near"]), lambda x: F.struct(x["line_no"].alias("line_no"), F.lit(1).alias("span"), x["terms"].alias("terms")))
        whole = F.when(is_file, best(F.array(F.struct(F.lit(-1).alias("line_no"), F.lit(1).alias("span"), F.flatten(F.transform(lines, lambda x: x["terms"])).alias("terms"))), F.lit(TEXT)))
        sure = F.array_min(F.filter(F.array(best(alone, most), whole), lambda x: x.isNotNull()))
        return let(sure, lambda x: F.coalesce(x, best(runs(lines), most)))

    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), _terms(x).alias("terms")))
    lines = F.transform(F.filter(lines, lambda x: F.size(x["terms"]) > 0), lambda x: F.struct(x["line_no"].alias("line_no"), x["terms"].alias("terms"), F.arrays_overlap(x["terms"], anchors).alias("near")))
    return F.when(F.arrays_overlap(_terms(text), anchors), let(lines, of_lines))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def license_scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` without its text, with license, score, line_no and basis ("header", "licence file", "inherited" or null)."""
    weights = Weights(*document_frequencies(files, text))
    rest = [c for c in files.columns if c not in (text, *OUT)]
    own = files.select(*rest, own_license(F.col(path), F.col(text), weights).alias("_own"))
    out = written(own.select(*rest, F.col("_own.license").alias("license"), (-F.col("_own.s")).alias("score"), F.col("_own.line_no").alias("line_no")))
    is_file = F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False))
    # of a directory's licence files the surest counts
    places = out.where(is_file & F.col("license").isNotNull()).groupBy(_folder(F.col(path)).alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("p")).select("above", F.col("p.license").alias("inherited"))
    folders = out.where(F.col(path).isNotNull()).select(_folder(F.col(path)).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nearest = folders.select("folder", F.explode(F.array_distinct(above)).alias("above")).join(places, "above").groupBy("folder").agg(F.max_by("inherited", F.struct(F.length("above"), "inherited")).alias("inherited"))
    # one folder may hold a third of all files: adaptive execution splits it, as nothing here needs a folder's rows together
    out = out.withColumn("folder", _folder(F.col(path))).join(written(nearest), "folder", "left")
    basis = F.when(F.col("license").isNotNull(), F.when(is_file, "licence file").otherwise("header")).when(F.col("inherited").isNotNull(), "inherited")
    return out.withColumn("basis", basis).withColumn("license", F.coalesce("license", "inherited")).drop("folder", "inherited")
