"""Licence scan: TF-IDF cosine to licence notices, then inheritance along directories.

A text is its sequence of terms: comment signs, line breaks and punctuation
are none, so a header block wrapped over commented lines reads like the
template.  Candidates are, around each cue word with a neighbour as in a template, the
stretch that the template would take there (a header, or a notice
inside a paragraph), so a window is as long as its template, whatever surrounds it; and the
whole text of such a document (a licence file).
Each distinct candidate becomes a sparse TF-IDF vector (document frequencies
over all candidates of the corpus) and meets the templates' vectors in a join
on terms.  A document that is a licence as a whole, or opens with a notice, speaks for its directory, as a licence
file does; documents without a notice inherit from the nearest ancestor
directory that has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

# Short public notices, the standard header texts and the opening of public licence texts, by licence name.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
                     "binary form must reproduce the above copyright notice, this list of conditions and the following "
                     "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
                     "binary form must reproduce the above copyright notice, this list of conditions and the following "
                     "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the "
                     "name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES} - {"Proprietary"})]
#: Each template has one of these terms, and a text without any has no candidate.
CUES = ("license", "licensed", "copyright", "permission", "domain", "commons", "cc", "redistributions")
#: A shorter text is no licence file as a whole; it may still open with a notice.
FILE_TERMS = 20
CUE = r"(?i)\b(?:" + "|".join(CUES) + r")\b"
_TERM = r"[\p{L}\p{N}]++(?:\.[0-9]++)*+"


def _split(text):
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _terms(texts: DataFrame, key: str) -> DataFrame:
    """``key, term, tf``."""
    return texts.select(key, F.explode(_split(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _places(spark) -> DataFrame:
    """One row: ``places``, a map from each pair of neighbouring terms with a cue word in a template to where it stands
    there and how many terms the template has (bounded by the list)."""
    terms = spark.createDataFrame([(text,) for _, text in TEMPLATES], "text string").select(_split(F.col("text")).alias("w"))
    cue = F.col("b.one").isin(*CUES) | F.col("b.two").isin(*CUES)
    pairs = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.struct(i.alias("k"), x.alias("one"), F.get("w", i + 1).alias("two")))
    placed = (terms.select(F.size("w").alias("size"), F.explode(pairs).alias("b")).where(cue)
                   .select(F.concat_ws(" ", "b.one", "b.two").alias("pair"), F.struct("b.k", "size").alias("at")).distinct())
    placed = placed.groupBy("pair").agg(F.collect_list("at").alias("at"))
    return placed.agg(F.map_from_entries(F.collect_list(F.struct("pair", "at"))).alias("places"))


def classify(candidates: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``key, text, licence, similarity`` (``key``: its digest) of each distinct candidate text (``text, n``) at ``threshold`` or more.

    The best template wins, among equals the first licence name.
    """
    spark = candidates.sparkSession
    templates = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEMPLATES)], "t int, licence string, text string")
    total = (candidates.agg(F.sum("n")).first()[0] or 0) + len(TEMPLATES)
    # a text may be long: its terms go by a digest of it
    texts = candidates.select(F.md5(F.col("text").cast("binary")).alias("key"), "text", "n")
    own = stored(_terms(texts, "key"), "licence-own-terms")
    theirs = _terms(templates, "t")
    df = (own.join(texts.select("key", "n"), "key").groupBy("term").agg(F.sum("n").alias("df"))
             .unionByName(theirs.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
             .groupBy("term").agg(F.sum("df").alias("df")))
    df = stored(df, "licence-df")
    weight = (1 + F.log("tf")) * (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1)

    def vectors(terms: DataFrame, key: str) -> DataFrame:
        w = terms.join(df, "term").select(key, "term", weight.alias("w"))
        norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))

    sides = vectors(theirs, "t").withColumnRenamed("w", "v")      # bounded by the list above
    cosine = (vectors(own, "key").join(F.broadcast(sides), "term").groupBy("key", "t")
                                 .agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("similarity"))
                                 .where(F.col("similarity") >= threshold))
    best = cosine.join(F.broadcast(templates.select("t", "licence")), "t")
    best = best.groupBy("key").agg(F.min_by("licence", F.struct(-F.col("similarity"), "licence")).alias("licence"),
                                   F.max("similarity").alias("similarity"))
    return texts.join(best, "key").select("key", "text", "licence", "similarity")


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, opening, at, size, whole, key`` for ``row, text``, and ``key, text, n`` of the distinct candidates.

    Where a text has two neighbouring terms of a template, one of them a cue word, the stretch that the
    template would take there is a candidate; the whole text of such a document is one, too.
    """
    opening = F.regexp_extract("text", r"\A[^\p{L}\p{N}]*+([^\n]*)", 1)                 # the first line with a term
    split = docs.where(F.coalesce(F.col("text").rlike(CUE), F.lit(False))).select(
        "row", _split(F.col("text")).alias("w"), F.size(_split(opening)).alias("opening"))
    split = split.where(F.size("w") > 1).crossJoin(F.broadcast(_places(docs.sparkSession)))
    hits = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.transform(
        F.coalesce(F.element_at("places", F.concat_ws(" ", x, F.get("w", i + 1))), F.array().cast("array<struct<k:int,size:int>>")),
        lambda at: F.struct((i - at["k"]).alias("at"), at["size"].alias("size"))))
    found = F.array_distinct(F.filter(F.flatten(hits), lambda x: x["at"] >= 0))
    terms = stored(split.select("row", "opening", "w", found.alias("found")).where(F.size("found") > 0), "licence-terms")
    cut = terms.select("row", "opening", F.explode("found").alias("s"), "w").select(
        "row", "opening", "s.at", "s.size", F.lit(False).alias("whole"), F.slice("w", F.col("s.at") + 1, F.col("s.size")).alias("w"))
    whole = terms.select("row", "opening", F.lit(0).alias("at"), F.size("w").alias("size"), F.lit(True).alias("whole"), "w")
    every = cut.unionByName(whole).withColumn("text", F.array_join("w", " ")).withColumn("key", F.md5(F.col("text").cast("binary")))
    texts = every.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    return (stored(every.select("row", "opening", "at", "size", "whole", "key"), "licence-candidates"),
            stored(texts, "licence-texts"))


def scan(docs: DataFrame, path, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, licence, origin, directory`` for each row of ``docs``.

    ``path`` is a column or expression: directories and a name, by ``/``.
    ``origin`` is ``file`` (the whole text, of ``FILE_TERMS`` or more, is a licence, or a notice is at least
    half of its first line),
    ``header`` (a notice stands elsewhere), ``inherited`` (from ``directory``) or
    ``none``.  With several notices the one nearest to its template counts, among equals the longest, then the first; with
    several licence files in a directory the most frequent licence, then the first name.  Null
    and empty texts have no notice but inherit; a null path inherits nothing.
    Repeated rows stay.  Other columns are not read; an empty table stays empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.regexp_replace(path.cast("string"), "/[^/]*$", "").alias("dir"),
                       F.when(F.col(text_col).cast("string").rlike(CUE), F.col(text_col).cast("string")).alias("text"))
    rows = stored(rows, "licence-rows")          # read several times: the numbers of rows must stay
    found, texts = candidates(rows.select("row", "text"))
    named = classify(texts, threshold).drop("text")
    hits = found.join(maybe_broadcast(stored(named, "licence-named")), "key")
    as_file = F.when(F.col("whole"), F.col("size") >= FILE_TERMS).otherwise(
        (F.col("at") < F.col("opening")) & (2 * F.col("size") >= F.col("opening")))
    best = F.min_by(F.struct("licence", as_file.alias("is_file")), F.struct(-F.col("similarity"), -F.col("size"), "at", "whole", "licence"))
    own = hits.groupBy("row").agg(best.alias("best")).select("row", F.col("best.licence").alias("own"), "best.is_file")
    own = stored(own, "licence-own")
    at = rows.join(own, "row", "left").select("doc_id", "row", "dir", "own", F.coalesce("is_file", F.lit(False)).alias("is_file"))
    at = stored(at, "licence-at")
    votes = at.where("is_file and dir is not null").groupBy("dir", "own").agg(F.count(F.lit(1)).alias("n"))
    of_dir = votes.groupBy("dir").agg(F.min_by("own", F.struct(-F.col("n"), "own")).alias("dir_licence"))
    of_dir = of_dir.withColumnRenamed("dir", "ancestor")
    # each directory joins its ancestors once; documents then join their directory
    steps = F.split("dir", "/", -1)
    dirs = at.select("dir").where("dir is not null").distinct()
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(
        F.slice(steps, 1, k), "/"))).alias("ancestor")).join(of_dir, "ancestor")
    nearest = up.groupBy("dir").agg(F.max_by(F.struct("ancestor", "dir_licence"), F.length("ancestor")).alias("up"))
    nearest = maybe_broadcast(stored(nearest, "licence-dirs").withColumnRenamed("dir", "_dir"))
    out = at.join(nearest, F.col("dir") == F.col("_dir"), "left")
    origin = (F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header")
               .when(F.col("up").isNotNull(), "inherited").otherwise("none"))
    return out.select(F.col("doc_id").alias(id_col), F.coalesce("own", F.col("up.dir_licence")).alias("licence"),
                      origin.alias("origin"),
                      F.when(F.col("own").isNull(), F.col("up.ancestor")).alias("directory"))
