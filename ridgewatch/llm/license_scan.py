"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text that names a licence gives passages: each line with a cue, each paragraph with one (a header of several lines is
one vector) and the whole text (a licence file is one vector). A passage is a sparse TF-IDF vector: a term's weight is
its count times log((1 + passages) / (1 + passages with the term)) + 1 over all passages of the corpus and the
templates. Vectors meet the templates' on their terms alone; the sum of the products over the norms is the cosine. A
file's own licence is what its SPDX tag says, with similarity 1, else the licence of its most similar passage, if that
reaches THRESHOLD.

A file with a licence of its own whose whole text is that similar to a template, or that has the name of a licence file,
rules its directory. Where a directory has several, the most similar decides, then the first licence by name. A file
without a licence of its own takes that of the nearest directory above it which has one, found by joining the file's
ancestor directories with the ruled directories on path.

Templates are notices, titles, headers and whole texts of well-known licences: NOTICES, HEADERS and the files in
licences/. Other licences are found only by an SPDX tag.

Only DataFrame functions are used. Templates and their terms are a fixed list, so these joins broadcast; of the
corpus only texts with a cue move, once, and everything else that moves is ids, counted terms and paths. A directory with
a third of all files makes a hot key on one side only, which adaptive execution splits.

Defined results: null text has no passages; a null path has no directory and inherits nothing; rows are told apart by
key, path and text, so rows with equal keys have a verdict each, and repeated rows are repeated in the result; ties go
to the first licence by name; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewatch.llm.common import store

#: Usual one-line notices and titles, by SPDX name.
NOTICES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["Redistributed under the BSD 2-Clause License.", "BSD 2-Clause License"],
    "BSD-3-Clause": ["Redistributed under the BSD 3-Clause License.", "BSD 3-Clause License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal license."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["Released under the ISC License.", "ISC License"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "MIT License"],
    "MPL-2.0": ["Subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain, see the Unlicense."],
    "Zlib": ["Released under the zlib License.", "zlib License"],
}
_GNU = (
    "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by "
    "the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have "
    "received a copy of the {name} along with this {what}."
)
#: The headers that licences ask for at the top of a file.
HEADERS = {
    "AGPL-3.0": _GNU.format(what="program", colon=":", name="GNU Affero General Public License", version="3"),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-2.0": _GNU.format(what="program", colon=";", name="GNU General Public License", version="2"),
    "GPL-3.0": _GNU.format(what="program", colon=":", name="GNU General Public License", version="3"),
    "LGPL-2.1": _GNU.format(what="library", colon=";", name="GNU Lesser General Public License", version="2.1"),
    "LGPL-3.0": _GNU.format(what="library", colon=":", name="GNU Lesser General Public License", version="3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
#: A passage with one of these, in either case, may be a licence.
CUES = r"(?i)licen[cs]e|copyright|spdx-|public domain"
#: An SPDX tag and its expression.
SPDX = r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9.+-]+\)?)*)"
#: Names of licence files.
NAMES = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
PARAGRAPHS = r"\n[ \t]*\n"
THRESHOLD = 0.6
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, int, str]]:
    """License, number and text of each template."""
    out = [(name, text) for name, texts in NOTICES.items() for text in texts] + list(HEADERS.items())
    whole = {f.name.removesuffix(".txt"): f.read_text() for f in resources.files(__package__).joinpath("licences").iterdir()}
    # The Affero licence is the general one under another name and date, but for a section.
    affero = whole["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("29 June 2007", "19 November 2007")
    whole["AGPL-3.0"] = affero.replace("GNU General Public License", "GNU Affero General Public License")
    return [(name, k, text) for k, (name, text) in enumerate([*out, *sorted(whole.items())])]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _CAPITALS, _CAPITALS.lower()), F.lit(r"[a-z0-9]+"), F.lit(0))


def passages(files: DataFrame) -> DataFrame:
    """Of files (key, path, mark, text) with a cue: key, path, mark, tag, and each distinct passage with its id and
    whether it is the whole text."""
    cited = lambda parts, more: F.transform(
        F.filter(parts, lambda x: x.rlike(CUES) & more(x)), lambda x: F.struct(x.alias("passage"), F.lit(False).alias("whole"))
    )
    text = F.col("text")
    lines = cited(F.split(text, "\n"), lambda x: F.lit(True))
    blocks = cited(F.split(text, PARAGRAPHS), lambda x: x.contains("\n"))
    own = F.array_distinct(F.concat(lines, blocks, F.array(F.struct(text.alias("passage"), F.lit(True).alias("whole")))))
    rows = files.where(text.rlike(CUES))
    return rows.select("key", "path", "mark", F.regexp_extract(text, SPDX, 1).alias("tag"), F.inline(own)).withColumn(
        "id", F.unhex(F.md5(F.col("passage").cast("binary")))
    )


def similarities(cited: DataFrame) -> DataFrame:
    """Per distinct passage: its best licence and the cosine (id, license, similarity); those without one are absent."""
    listed = cited.sparkSession.createDataFrame(templates(), "license string, number int, passage string")
    distinct = cited.groupBy("id").agg(F.count("*").alias("times"), F.first("passage").alias("passage"))
    counted = distinct.select("id", "times", F.explode(terms(F.col("passage"))).alias("term"))
    tf = store(counted.groupBy("id", "times", "term").agg(F.count("*").alias("tf")), "licence-terms")
    own = listed.select("license", "number", F.explode(terms(F.col("passage"))).alias("term")).groupBy("license", "number", "term").agg(
        F.count("*").alias("tf")
    )
    total = cited.count() + len(templates())
    df = (
        tf.select("term", "times").unionByName(own.select("term", F.lit(1).cast("bigint").alias("times")))
        .groupBy("term").agg(F.sum("times").alias("df"))
    )
    idf = df.select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    # Dealt by passage once: norms and products are then summed where they are.
    weighted = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w")).repartition("id")
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    fixed = own.join(idf, "term").select("license", "number", "term", (F.col("tf") * F.col("idf")).alias("v"))
    fixed_norms = fixed.groupBy("license", "number").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("fixed_norm"))
    dots = (
        weighted.join(F.broadcast(fixed), "term").groupBy("id", "license", "number")
        .agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    )
    cosine = dots.join(norms, "id").join(F.broadcast(fixed_norms), ["license", "number"]).select(
        "id", "license", F.round(F.col("dot") / (F.col("norm") * F.col("fixed_norm")), 6).alias("similarity")
    )
    return (
        cosine.where(F.col("similarity") >= THRESHOLD)
        .groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("best"))
        .select("id", F.col("best.license").alias("license"), (-F.col("best.less")).alias("similarity"))
    )


def _parents(path: Column) -> Column:
    """depth and directory of each directory above a path, the root ("") with depth 0."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")),
    )


def scan(files: DataFrame, key: str = "key", path: str = "path", text: str = "text") -> DataFrame:
    """Per file: key, path, own_license, similarity, is_license_file, license, inherited_from (a directory)."""
    rows = files.select(
        F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).cast("string").alias("text")
    ).withColumn("mark", F.xxhash64("text"))
    cited = store(passages(rows), "licence-cited")
    tag = F.max("tag")
    scored = cited.join(similarities(cited), "id", "left").groupBy("key", "path", "mark").agg(
        F.min(F.when(F.col("license").isNotNull(), F.struct((-F.col("similarity")).alias("less"), "license"))).alias("best"),
        F.bool_or(F.col("whole") & F.col("license").isNotNull()).alias("only"), F.when(tag != "", tag).alias("tag"),
    )
    own = scored.select(
        F.struct("key", "path", "mark").alias("row"), F.coalesce("tag", "best.license").alias("own_license"),
        F.when(F.col("tag").isNotNull(), 1.0).otherwise(-F.col("best.less")).alias("similarity"), "only",
    ).where("own_license is not null")
    met = rows.select(F.struct("key", "path", "mark").alias("it"), "key", "path").join(own, F.col("it").eqNullSafe(F.col("row")), "left")
    named_so = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(NAMES), F.lit(False))
    rules = F.col("own_license").isNotNull() & (F.col("only") | named_so)
    named = store(met.select("key", "path", "own_license", "similarity", F.coalesce(rules, F.lit(False)).alias("only")), "licence-own")
    directory = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), "/")
    ruled = (
        named.where("only and path is not null")
        .groupBy(directory.alias("dir"))
        .agg(F.min(F.struct((-F.col("similarity")).alias("less"), F.col("own_license"))).alias("best"))
        .select("dir", F.col("best.own_license").alias("rule"))
    )
    # The directories are few next to the files: each distinct one finds its ruler once, then files look theirs up.
    places = named.where("path is not null").select(directory.alias("place"), F.col("path")).groupBy("place").agg(
        F.min("path").alias("path")
    )
    rulers = (
        places.select("place", F.inline(_parents(F.col("path")))).join(ruled, "dir")
        .groupBy("place").agg(F.max(F.struct("depth", "dir", "rule")).alias("ruler"))
    )
    out = named.withColumn("place", directory).join(rulers.withColumnRenamed("place", "p"), F.col("place") == F.col("p"), "left")
    takes = F.col("own_license").isNull() & F.col("ruler").isNotNull()
    return out.select(
        F.col("key").alias(key), F.col("path").alias(path), "own_license", "similarity",
        F.col("only").alias("is_license_file"), F.coalesce("own_license", "ruler.rule").alias("license"),
        F.when(takes, F.col("ruler.dir")).alias("inherited_from"),
    )


def document_paths(documents: DataFrame) -> DataFrame:
    """documents as files: one directory for each source, below it one for each 50 ids, below that each language."""
    part = F.floor(F.col("doc_id") / 50).cast("bigint").cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), part, F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return documents.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
