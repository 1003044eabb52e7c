"""Licence detection by sparse TF-IDF cosine with templates, and inheritance along directories.

A notice is a line or a paragraph that is close to a template: both become sparse TF-IDF vectors, compared over
shared terms only.  Long licence texts are recognised by their own paragraphs.  All lines and paragraphs are
looked at; those without a word that any template needs are passed by, which loses nothing.  A row
without a licence of its own takes that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_spread, small_batches

#: Texts that stand for each licence, by SPDX name; paragraphs of the licences and customary notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "Released under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Released under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain (CC0)."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
LEAST = 0.5
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
_TERM = re.compile(TERM)


#: English words too common to single out a line, the most common first.
COMMON = ("the", "of", "and", "to", "in", "a", "is", "that", "it", "be", "as", "for", "with", "by", "this", "are", "at", "from", "or", "on", "an", "not", "all", "any", "use", "may", "you", "no", "its", "which", "other")


class Gate:
    """Which lines and paragraphs reach a cosine of `least` with a template, by the same weights as match().

    A unit without a strong term is passed by at once: the terms that are not strong hold under least ** 2 of each
    template's squared weight, so no vector made of these reaches the limit.
    """

    def __init__(self, templates, least: float):
        n, counts = len(templates), [Counter(_TERM.findall(t.lower())) for _, t in templates]
        df = Counter(t for c in counts for t in c)
        self.least, self.rare = least - 1e-6, math.log(n + 1) + 1
        self.idf = {t: math.log((n + 1) / (x + 1)) + 1 for t, x in df.items()}
        self.sides: dict[str, list[tuple[int, float]]] = {}
        self.strong: set[str] = set()
        for k, c in enumerate(counts):
            w = {t: (1 + math.log(x)) * self.idf[t] for t, x in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            weak, mass = set(), 0.0
            for t in COMMON:
                mass += (w.get(t, 0.0) / norm) ** 2
                if mass >= least * least - 1e-9:
                    break
                weak.add(t)
            for t, x in w.items():
                self.sides.setdefault(t, []).append((k, x / norm))
                if t not in weak:
                    self.strong.add(t)

    def passes(self, terms: list[str]) -> bool:
        if self.strong.isdisjoint(terms):
            return False
        dots: dict[int, float] = {}
        square = 0.0
        for t, x in Counter(terms).items():
            w = (1 + math.log(x)) * self.idf.get(t, self.rare)
            square += w * w
            for k, side in self.sides.get(t, ()):
                dots[k] = dots.get(k, 0.0) + w * side
        return max(dots.values(), default=0.0) >= self.least * math.sqrt(square)

    def units(self, text: str) -> list[str]:
        """Distinct lines and paragraphs of a text that pass, stripped; wrapped lines are joined by spaces."""
        found, block, terms = {}, [], []
        for line in [*text.split("\n"), ""]:
            if line.strip():
                own = _TERM.findall(line.lower())
                block.append(line)
                terms += own
                if self.passes(own):
                    found[" ".join(line.split())] = None
            elif block:
                if len(block) > 1 and self.passes(terms):
                    found[" ".join(" ".join(block).split())] = None
                block, terms = [], []
        return list(found)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _weights(texts: DataFrame, idf: DataFrame) -> DataFrame:
    """(key, term, weight): unit TF-IDF vectors of (key, text); one row a distinct term."""
    tf = texts.select("key", F.explode(_terms(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(F.broadcast(idf), "term").select("key", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("weight"))


def match(texts: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(text, license, score) of distinct texts whose best template has a cosine of `least` or more.

    Document frequencies are those of terms over the templates (a bounded table, and so is broadcast); terms
    that no template has carry the largest weight and only lengthen a text's vector.
    """
    spark = texts.sparkSession
    known = spark.createDataFrame([(i, name, t) for i, (name, t) in enumerate(templates)], "template int, license string, text string")
    n = len(templates)
    df = known.select("template", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    sides = _weights(known.select(F.col("template").alias("key"), "text"), idf).select(F.col("key").alias("template"), "term", F.col("weight").alias("tw"))
    distinct = texts.select("text").where("text is not null").distinct().withColumn("key", F.sha2("text", 256))
    rare = F.log(F.lit(n + 1.0)) + 1
    tf = distinct.select("key", F.explode(_terms(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(F.broadcast(idf), "term", "left").select("key", "term", ((1 + F.log("tf")) * F.coalesce("idf", rare)).alias("w"))
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = w.join(F.broadcast(sides), "term").groupBy("key", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norm, "key").select("key", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("template")).alias("nth"))).alias("b"))
    named = best.select("key", F.col("b.score").alias("score"), (-F.col("b.nth")).cast("int").alias("template")).join(F.broadcast(known.select("template", "license")), "template")
    return distinct.join(named, "key").select("text", "license", "score")


def notices(files: DataFrame, text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(blob, license, score) of distinct texts that bear a notice; blob: the SHA-256 of the text.

    Of several notices that with the best score counts, of equal ones the first licence by name.  Null and empty
    texts bear none; a very long one is read whole; copies are looked at once.
    """
    small_batches(files)
    gate = Gate(templates, least)

    @F.arrow_udf("array<string>")
    def units(text: pa.Array) -> pa.Array:
        return pa.array([gate.units(t.as_py()) if t.is_valid else [] for t in text], pa.list_(pa.string()))

    some = files.select(F.col(text_col).alias("text")).withColumn("units", units("text")).where(F.size("units") > 0)
    heads = cut(some.select(F.sha2("text", 256).alias("blob"), F.explode("units").alias("text")).distinct())
    found = heads.join(match(heads, templates, least), "text")
    return found.groupBy("blob").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("blob", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def detect(files: DataFrame, id_col: str, path_col: str, text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, license, score, origin): one row per row of files; assign() of their notices.

    Null texts bear no notice; repeated rows repeat; an empty table gives none; other columns do not matter.
    """
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.sha2(text_col, 256), F.lit("")).alias("blob"))
    return assign(rows, notices(files, text_col, templates, least))


def assign(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(id, path, license, score, origin) of rows (id, path, blob), by the notices (blob, license, score).

    origin is "header" for a notice in the row's own text, "file" for one in a licence file, "inherited" from the
    nearest licence file in the directory or one above, else null with a null licence.  Of several licence files
    of a directory that with the best score counts, of equal ones the first licence by name.  A null path
    inherits nothing.  A text or directory of very many rows is joined in parts.
    """
    rows, own = cut(rows), cut(own)
    is_file = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    marked = cut(join_spread(rows, own, "blob", hot_keys(rows, "blob")).select("id", "path", F.coalesce(folder, F.lit("")).alias("at"), is_file.alias("own"), "license", "score"))
    above = marked.where("own and license is not null").groupBy(F.col("at").alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    # every directory is joined once with its ancestors; documents then meet their directory
    dirs = marked.where("path is not null").select("at").distinct()
    steps = F.split("at", "/")
    ancestors = dirs.select("at", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/"))))).alias("dir"))
    near = ancestors.join(above, "dir").groupBy("at").agg(F.max_by("b", F.length("dir")).alias("b")).select("at", F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    out = join_spread(marked, near, "at", hot_keys(marked, "at"))
    inherited = F.col("license").isNull() & F.col("path").isNotNull() & F.col("dir_license").isNotNull()
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("own"), F.lit("file")).otherwise(F.lit("header"))).when(inherited, F.lit("inherited"))
    either = lambda a, b: F.when(inherited, F.col(b)).otherwise(F.col(a)).alias(a)
    return out.select("id", "path", either("license", "dir_license"), either("score", "dir_score"), origin.alias("origin"))
