"""Licence scan in DataFrame functions only: TF-IDF cosine of headers and licence files to templates, then inheritance.

Every line of a file and every run of 2, 4 and 8 of its lines is a possible header, as notices are wrapped over lines;
a licence file also counts as a whole. Each is compared with the templates by the cosine of sparse TF-IDF vectors over
the templates' words (letters and digits, so marks of comments don't count); a file without a licence of its own takes
that of the licence file in its nearest ancestor directory.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import cut

#: Names of licences in identifiers, and where their notices differ; fixed values.
IDENTIFIERS = ("Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")
#: Common licence statements, notices and headings of licence files; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    *((name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS),
)
#: Numbers of lines that make a unit.
RUNS = (1, 2, 4, 8)
WORD = r"[a-z0-9]+"
#: The type of a file's units.
_UNITS = "array<struct<line:int,lines:int,unit:string>>"
#: Names of files that give a licence for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.(txt|md))?$"


@dataclass(frozen=True)
class Templates:
    """Unit TF-IDF vectors of the templates: name, and weight of each word; the weight of a word in any text."""

    names: list[str]
    vectors: list[dict[str, float]]
    idf: dict[str, float]

    def anchors(self, cosine: float) -> list[str]:
        """Words of which any text with this cosine to some template has one: the rest of each vector is too short."""
        chosen: set[str] = set()
        for vector in self.vectors:
            left = sum(w * w for word, w in vector.items() if word not in chosen)
            for word in sorted(vector, key=lambda w: (-self.idf[w], w)):
                if left < cosine * cosine:
                    break
                if word not in chosen:
                    chosen.add(word)
                    left -= vector[word] ** 2
        return sorted(chosen)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def weigh(files: DataFrame, text: str, templates: tuple = TEMPLATES) -> Templates:
    """The templates' vectors, with document frequencies counted over all files. The word list is that of the templates."""
    counted = [re.findall(WORD, body.lower()) for _, body in templates]
    words = sorted({w for own in counted for w in own})
    total = files.count()
    vocabulary = F.array(*[F.lit(w) for w in words])
    held = files.select(F.explode(F.array_intersect(_words(F.col(text)), vocabulary)).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in held.collect()}
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1 for w in words}
    vectors = []
    for own in counted:
        raw = {w: own.count(w) * idf[w] for w in sorted(set(own))}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors.append({w: v / norm for w, v in raw.items()})
    return Templates([n for n, _ in templates], vectors, idf)


def headers(files: DataFrame, weights: Templates, key: str, path: str, text: str, cosine: float) -> DataFrame:
    """(key, path, licence, score, line, lines): the best template of each file that has a header or is a licence file close to one."""
    anchors = weights.anchors(cosine)
    anchor = F.lit("(?<![a-z0-9])(?:" + "|".join(anchors) + ")(?![a-z0-9])")
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text")).filter(F.regexp_like(F.lower("text"), anchor))
    name = F.element_at(F.split("path", "/"), -1)

    # squared length of a unit's vector: words outside the templates weigh as much as the rarest inside
    rarest = max(weights.idf.values())
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.idf.items()) for x in pair])
    vocabulary = F.array(*[F.lit(w) for w in sorted(weights.idf)])

    # squared weights of each word in all templates, one row of numbers after the other
    width = len(weights.vectors)
    shares = F.lit(np.array([v.get(w, 0.0) ** 2 for w in sorted(weights.idf) for v in weights.vectors]))
    none = F.lit(np.zeros(width))

    def mass(known: Column) -> Column:
        """The largest share of a template's squared vector that lies on the known words."""
        row = lambda w: F.slice(shares, (F.array_position(vocabulary, w).cast("int") - 1) * width + 1, F.lit(width))
        return F.array_max(F.aggregate(known, none, lambda a, w: F.zip_with(a, row(w), lambda x, y: x + y)))

    def near(unit: Column) -> Column:
        """Whether a unit and what it is part of may reach the cosine: the words that it shares with a template hold at least the cosine's square of the template's vector."""
        return mass(F.array_intersect(vocabulary, _words(unit))) >= cosine * cosine - 1e-9

    def may(unit: Column) -> Column:
        """The same for a unit by itself: the share of its own vector that lies on known words counts too, others weigh as if none came twice."""

        def bound(ws: Column) -> Column:
            def weighed(known: Column) -> Column:
                number = lambda w: F.size(F.filter(ws, lambda x: x == w))
                inside = F.aggregate(known, F.lit(0.0), lambda a, w: a + F.pow(number(w) * F.element_at(table, w), F.lit(2)))
                tokens = F.aggregate(known, F.lit(0), lambda a, w: a + number(w))
                return mass(known) * inside >= cosine * cosine * (inside + (F.size(ws) - tokens) * rarest * rarest) * (1 - 1e-9)

            return F.element_at(F.transform(F.array(F.array_intersect(vocabulary, ws)), weighed), 1)

        return F.element_at(F.transform(F.array(_words(unit)), bound), 1)

    def runs(ls: Column, marked: Column, n: int) -> Column:
        """Runs of n lines with at least one of the marked ones."""
        last = F.size(ls) - n
        starts = F.array_distinct(F.flatten(F.transform(marked, lambda p: F.sequence(F.greatest(F.lit(0), p - n + 1), F.least(p, last)))))
        made = F.transform(starts, lambda i: F.struct(i.alias("line"), F.lit(n).alias("lines"), F.array_join(F.slice(ls, i + 1, n), " ").alias("unit")))
        return F.when(last >= 0, F.filter(made, lambda u: may(u["unit"]))).otherwise(F.array().cast(_UNITS))

    def around(ls: Column) -> Column:
        marked = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.regexp_like(F.lower(F.get(ls, i)), anchor))
        marked = F.filter(marked, lambda i: near(F.array_join(F.slice(ls, F.greatest(F.lit(1), i + 2 - max(RUNS)), 2 * max(RUNS) - 1), " ")))
        return F.element_at(F.transform(F.array(marked), lambda m: F.flatten(F.array(*[runs(ls, m, n) for n in RUNS]))), 1)

    # the lines are one value of an array of one, so that they are split once
    units = F.element_at(F.transform(F.array(F.split("text", "\n")), around), 1)
    whole = F.array(F.struct(F.size(F.split("text", "\n")).alias("line"), F.lit(0).alias("lines"), F.col("text").alias("unit")))
    units = F.when(name.rlike(LICENCE_FILE), F.concat(units, whole)).otherwise(units)
    lines = rows.select("key", "path", F.explode(units).alias("u")).select("key", "path", (F.col("u.line") * 16 + F.col("u.lines")).alias("line"), F.col("u.unit").alias("unit"))
    tokens = lines.select("key", "path", "line", F.explode(_words(F.col("unit"))).alias("w")).groupBy("key", "path", "line", "w").agg(F.count("*").alias("tf"))
    known = F.element_at(table, F.col("w"))
    weighed = tokens.withColumn("x", F.col("tf") * F.coalesce(known, F.lit(rarest)))
    dots = [F.sum(F.col("x") * F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(v.items()) for x in pair]), F.col("w")), F.lit(0.0))) for v in weights.vectors]
    summed = weighed.groupBy("key", "path", "line").agg(F.sum(F.col("x") * F.col("x")).alias("square"), *[d.alias(f"d{i}") for i, d in enumerate(dots)])
    scores = F.array(*[F.struct(F.round(F.col(f"d{i}") / F.sqrt("square"), 9).alias("score"), F.lit(-i).alias("rank")) for i in range(len(dots))])
    best = summed.select("key", "path", "line", F.array_max(scores).alias("best")).filter(F.col("best.score") >= cosine)
    names = F.array(*[F.lit(n) for n in weights.names])
    top = best.groupBy("key", "path").agg(F.max(F.struct(F.col("best.score").alias("score"), F.col("best.rank").alias("rank"), (-F.col("line")).alias("line"))).alias("top"))
    return top.select("key", "path", F.get(names, -F.col("top.rank")).alias("licence"), F.col("top.score").alias("score"), F.floor(-F.col("top.line") / 16).cast("long").alias("line"), F.pmod(-F.col("top.line"), F.lit(16)).cast("long").alias("lines"))


def directory(path: Column | str) -> Column:
    """The directory of a path, '' for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, given, from_dir, up): for each distinct directory the licence of its nearest ancestor, itself first.

    directories has (dir); licensed one row (dir, licence) per directory with a licence file.
    """
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(F.concat_ws("/", F.slice(steps, F.lit(1), i)).alias("at"), i.alias("depth")))
    chains = directories.distinct().select("dir", F.size(steps).alias("depth0"), F.explode(above).alias("a")).select("dir", "depth0", F.col("a.at").alias("at"), F.col("a.depth").alias("depth"))
    met = chains.join(licensed.withColumnRenamed("dir", "at"), "at")
    nearest = met.groupBy("dir").agg(F.max(F.struct("depth", "at", "licence")).alias("n"), F.max("depth0").alias("depth0"))
    return nearest.select("dir", F.col("n.licence").alias("given"), F.col("n.at").alias("from_dir"), (F.col("depth0") - F.col("n.depth")).cast("long").alias("up"))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", cosine: float = 0.8, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per file: key, path, own, score, line, lines, licence, from_dir, up.

    own is the template closest to a line or run of lines (or, for a licence file, to the whole text) with at least this
    cosine, score, line and lines say how close, where it begins and how many lines it has (a whole text: the line after
    the last, 0 lines); of equal scores the earlier template, then the first line, then the shorter run is taken. licence is own, else that of the licence file in the nearest directory
    above (from_dir, up steps away), else null. A directory with several licence files takes the closest one's, then
    the least name. Null and empty texts have no licence of their own; a null path inherits nothing; rows that repeat
    key and path share their results; other columns are not used. The words outside the templates weigh like the
    rarest inside, so the scores need counts of template words only.
    """
    weights = weigh(files.select(text), text, templates)
    found = cut(headers(files, weights, key, path, text, cosine).dropDuplicates(["key", "path"]))
    given = found.filter(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE))
    licensed = given.groupBy(directory("path").alias("dir")).agg(F.max_by("licence", F.struct("score", F.col("licence"))).alias("licence"))
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), directory(F.col(path)).alias("dir"))
    handed = inherit(rows.select("dir").filter("dir is not null"), licensed)
    own = found.withColumnRenamed("key", "key2").withColumnRenamed("path", "path2")
    joined = rows.join(own, F.col("key").eqNullSafe(F.col("key2")) & F.col("path").eqNullSafe(F.col("path2")), "left").join(handed, "dir", "left")
    mine = F.col("licence").isNotNull()
    return joined.select(
        F.col("key").alias(key), F.col("path").alias(path), F.col("licence").alias("own"), "score", "line", "lines",
        F.coalesce("licence", "given").alias("licence"), F.when(~mine, F.col("from_dir")).alias("from_dir"), F.when(~mine, F.col("up")).alias("up"),
    )
